"""Operators of a training-data pipeline (dedup, decontamination, tokens,
secrets, personal data, toxicity, quality).  Nothing else in the library
imports this subpackage."""

"""Scalar building blocks: URL expressions, text helpers, the HTML pass."""

"""Structured Streaming jobs over the event log and captured responses."""

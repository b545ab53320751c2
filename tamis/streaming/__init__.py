"""Validation of Structured Streaming tables."""

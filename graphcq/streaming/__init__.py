"""Structured Streaming ends of the batch engine."""

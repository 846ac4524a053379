"""Structured Streaming: the same plans over event time."""

"""Composite plans: hybrid retrieval, feedback and evaluation, governance, metering."""

"""Structured Streaming jobs over run logs."""

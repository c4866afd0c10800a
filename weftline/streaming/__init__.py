"""Streaming jobs over the call log."""

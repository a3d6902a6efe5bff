"""Structured Streaming over dropped log files."""

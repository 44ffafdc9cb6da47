"""Structured Streaming over statements."""

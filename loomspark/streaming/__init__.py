"""Structured Streaming over session logs."""

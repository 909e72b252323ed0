"""Structured Streaming jobs over capture folders."""

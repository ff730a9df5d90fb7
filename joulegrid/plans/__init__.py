"""Whole questions about a capture, put together from operators."""

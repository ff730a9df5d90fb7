"""Operators over samples, events, gaps and rules."""

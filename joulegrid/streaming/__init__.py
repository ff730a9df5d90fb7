"""Stateful operators over unbounded streams."""

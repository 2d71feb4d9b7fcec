"""Operators: each takes frames and returns a frame."""

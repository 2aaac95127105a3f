"""Structured Streaming versions of the state operators."""

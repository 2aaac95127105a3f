"""Typed scans and guarded sinks."""

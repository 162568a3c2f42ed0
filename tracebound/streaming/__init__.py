"""Structured Streaming versions of the ordered logs."""

"""Structured Streaming slices."""

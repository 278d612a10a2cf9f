"""Structured Streaming forms of the windowed summaries."""

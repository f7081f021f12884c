"""Structured Streaming forms of preparation and metrics."""

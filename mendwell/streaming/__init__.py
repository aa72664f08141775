"""Structured Streaming forms of the polling jobs and sliding metrics."""

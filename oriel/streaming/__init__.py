"""Structured Streaming forms of the bar builders and the recursive variance."""

"""Structured Streaming (an extension: the pipeline these operators come from is batch only)."""

"""Structured Streaming forms of resumable work."""

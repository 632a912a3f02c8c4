"""Structured Streaming forms of the versioned operators."""

"""Streaming forms of the change jobs."""

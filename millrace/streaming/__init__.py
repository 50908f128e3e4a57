"""Structured Streaming forms of the batch operators; see the README."""

"""Readers and sinks; see the README."""

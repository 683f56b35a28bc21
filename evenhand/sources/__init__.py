"""Readers and append sinks."""

"""Streaming of the archive engine."""

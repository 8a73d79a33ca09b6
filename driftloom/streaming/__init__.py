"""Streaming of the process-change engine."""

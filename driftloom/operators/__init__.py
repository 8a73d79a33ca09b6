"""Operators of the process-change engine."""

"""Plans of the process-change engine."""

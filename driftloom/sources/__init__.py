"""Sources of the process-change engine."""

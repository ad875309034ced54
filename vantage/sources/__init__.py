"""Sources of the horizon engine."""

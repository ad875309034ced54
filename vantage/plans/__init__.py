"""Plans of the horizon engine."""

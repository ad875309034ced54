"""Functions of the horizon engine."""

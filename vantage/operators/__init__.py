"""Operators of the horizon engine."""

"""Streaming of the horizon engine."""

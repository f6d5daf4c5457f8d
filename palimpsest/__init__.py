"""Versioned, event-sourced and windowed analytics as plain Spark DataFrames."""

"""Pulling ordered results row by row."""

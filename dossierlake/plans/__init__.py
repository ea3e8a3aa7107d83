"""Whole jobs composed from operators and column functions."""

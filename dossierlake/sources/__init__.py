"""Readers and writers for the bronze, silver, gold and reference tables."""

"""Structured Streaming versions of the bronze-to-silver and silver-to-gold jobs."""

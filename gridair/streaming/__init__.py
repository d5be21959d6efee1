"""Structured Streaming jobs; each keeps current what a table operator computes."""

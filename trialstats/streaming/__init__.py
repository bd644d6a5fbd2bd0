"""Structured Streaming jobs; each equals its batch twin on the same input."""

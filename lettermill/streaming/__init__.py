"""Streaming jobs over topics."""

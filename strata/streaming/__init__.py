"""Structured Streaming jobs and the replay that feeds them."""

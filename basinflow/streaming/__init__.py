"""Structured Streaming queries and how to drive one to its end."""

"""Structured Streaming forms of the task operators."""

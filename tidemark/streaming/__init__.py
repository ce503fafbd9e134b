"""Structured Streaming forms of operators that keep state by document."""

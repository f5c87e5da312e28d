"""Stateful operators, as batch windows and as Structured Streaming."""

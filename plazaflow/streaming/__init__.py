"""Structured Streaming forms of the temporal operators: extensions beyond batch use."""

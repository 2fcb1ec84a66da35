"""Structured Streaming versions of the intake and the counters."""

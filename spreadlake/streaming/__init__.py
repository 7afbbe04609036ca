"""Structured Streaming forms of the stateful table changes; beyond the batch operators that they mirror."""

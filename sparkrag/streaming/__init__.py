"""Structured Streaming forms of the stateful operators; the batch forms define the truth."""

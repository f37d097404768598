"""Composite plans: corpus build, semantic parsing, search and evaluation."""

"""Structured Streaming versions of the folds."""

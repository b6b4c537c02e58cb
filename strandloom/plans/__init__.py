"""Registered queries, their SQL twins, and the declarative workflow runner."""

"""Incremental batch steps: what is new, what is due, what replaces what."""

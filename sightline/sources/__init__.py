"""Readers and reshaping of raw inputs into the domain tables, and the sinks."""

"""Equity research analytics as Spark DataFrame jobs."""

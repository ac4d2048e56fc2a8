"""Audit-report analytics as DataFrame, Spark SQL and Structured Streaming queries."""

"""Specloom: turns gateway access logs into API documentation with Spark."""

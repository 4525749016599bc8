"""Registered queries, the log they run on, and their SQL counterparts."""

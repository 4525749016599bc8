"""Whole jobs: ingest, build, document."""

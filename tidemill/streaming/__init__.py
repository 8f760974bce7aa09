"""Continuous ingest and rollups."""

"""Ingestion, snapshots and connectors."""

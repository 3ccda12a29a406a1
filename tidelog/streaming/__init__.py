"""Structured Streaming ingestion and continuous views."""

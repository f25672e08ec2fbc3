"""Incremental delivery of results, watched folders, and event-time windows."""

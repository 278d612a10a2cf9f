"""Configurations, scans and sinks."""

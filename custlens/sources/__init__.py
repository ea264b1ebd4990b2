"""Scans, sinks, file validation and quarantine."""

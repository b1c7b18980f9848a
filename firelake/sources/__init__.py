"""Scans, payload parsers, tables and sinks."""

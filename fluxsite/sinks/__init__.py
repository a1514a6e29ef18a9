"""Sinks: export of the enriched and report tables."""

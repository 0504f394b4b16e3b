"""Readers for landed files, typed ingest, policy files and sinks."""

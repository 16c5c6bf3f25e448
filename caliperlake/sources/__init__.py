"""Adapters, sources and sinks."""

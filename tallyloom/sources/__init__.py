"""Readers, the source registry and the sinks."""

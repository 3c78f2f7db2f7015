"""Readers, normalisation and sinks."""

"""Readers and decoders of tiles, metadata and images."""

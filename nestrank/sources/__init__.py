"""Readers, writers and payload normalisers."""

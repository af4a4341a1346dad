"""Pluggable models: embedders, choosers and clusterers, with deterministic offline defaults."""

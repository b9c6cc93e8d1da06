"""Relational, set-similarity and graph operators."""

"""Siltstone operators."""

"""Siltstone functions."""

"""Siltstone: analytics over timestamped, located incident logs, written on Spark DataFrames."""

"""Spark jobs for studying how pairs of price series move together."""

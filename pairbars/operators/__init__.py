"""Operators on bars and pairs of bar series."""

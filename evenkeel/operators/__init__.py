"""Relational and time-series operators over any table with a key and an integer tick."""

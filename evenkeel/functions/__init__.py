"""Scalar expressions and reducers: Column in, Column out."""

"""Operators of the mining engine."""

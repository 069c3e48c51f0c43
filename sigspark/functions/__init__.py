"""Numeric functions."""

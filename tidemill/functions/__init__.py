"""Scalar helpers and the registries of aggregate functions."""

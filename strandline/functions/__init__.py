"""Scalar and nested functions."""

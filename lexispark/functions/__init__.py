"""Scalar and array functions over text and dates."""

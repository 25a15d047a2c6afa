"""Scalar, array and Arrow functions."""

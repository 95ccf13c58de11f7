"""Scalar expressions: plain Column functions that stay inside code generation."""

"""Scalar expressions and text derivation."""

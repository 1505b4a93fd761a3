"""Scalar expressions: value patterns, masks, hash keys."""

"""Distributed operators: profiling, dependencies, keys, relationships, quality, normalization and model loading."""

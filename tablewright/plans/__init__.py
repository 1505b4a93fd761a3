"""Driver-side algorithms on metadata: dependencies, normal forms, semantic types, names and designs."""

"""Index operators and their life cycle."""

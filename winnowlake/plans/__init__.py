"""Predicates of a plan, the clauses they imply on file metadata, and their translation."""

"""Data files, their listing, and the metadata store."""

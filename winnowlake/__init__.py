"""Data skipping and analytics on Spark DataFrames."""

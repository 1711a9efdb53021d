"""Conversational-data jobs on Spark: DataFrames in, DataFrames out."""

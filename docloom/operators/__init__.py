"""Relational, scoring, evaluation and dataset operators on DataFrames."""

"""Operators over DataFrames: joins, label graphs, quality assurance, samples, vectors."""

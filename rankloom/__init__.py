"""Ranking, gating and judging of scored alternatives on Spark DataFrames."""

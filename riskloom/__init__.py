"""Cohort, credit-risk and causal analytics on Spark DataFrames."""

"""Retail sales reports on Spark DataFrames."""

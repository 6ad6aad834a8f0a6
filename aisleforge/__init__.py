"""Retail assortment analytics on Spark DataFrames."""

"""Operators over the catalog tables: plain functions from DataFrames to DataFrames."""

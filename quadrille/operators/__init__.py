"""Algebra nodes as DataFrames, paging and sampling."""

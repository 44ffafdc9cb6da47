"""Datasets and result formats."""

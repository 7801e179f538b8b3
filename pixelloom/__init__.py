"""Imaging-cytometry pixel records as Spark DataFrames: select, composite, resample, write."""

__version__ = "0.1.0"

"""Manipulation-detection and campaign-analytics engine on PySpark DataFrames."""

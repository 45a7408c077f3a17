"""Temporal multiplex graph and text analytics, written for Spark DataFrames."""

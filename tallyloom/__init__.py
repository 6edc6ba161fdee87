"""Tallyloom: evaluation and measurement of logged question answering on Spark DataFrames."""

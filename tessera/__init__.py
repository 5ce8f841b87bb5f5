"""Tessera: an analytics engine for conversational and deal data on Spark DataFrames."""

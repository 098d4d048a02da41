"""Lectern: bibliographic and long-document analytics on Spark DataFrames."""

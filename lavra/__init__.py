"""Lavra: a Spark-native engine for tracing how corporate information is used in AI tools.

Every operator takes and returns DataFrames; see README.md for the map of the package.
"""

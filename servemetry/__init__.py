"""Spark jobs over serving telemetry: request logs, counter scrapes, router
decisions, benchmark artifacts, conversations and node inventories.

Every operator is a function from DataFrames to a DataFrame, every rule a
function from Columns to a Column. Thresholds are keyword arguments.
"""

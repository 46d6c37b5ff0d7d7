"""Operators of a training-data pipeline; their queries are in `queries`. No other part of the library imports this."""

"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it. Every operator takes a DataFrame and
names of the columns it needs, works on those columns only (other columns, even
of clashing names, never meet the operator's own), and returns a DataFrame.
"""

"""Operators over DataFrames: predicates, queries, reducers, joins, versions, merges, periods, blobs."""

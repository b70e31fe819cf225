"""Scalar functions as Columns: localised text, dictionaries, file names, magic numbers."""

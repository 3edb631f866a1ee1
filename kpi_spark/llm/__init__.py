"""Operators for preparing language-model training data, one module each.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; see each module's docstring for what it does with nulls,
empty or very long texts, repeated rows and clashing column names.
"""

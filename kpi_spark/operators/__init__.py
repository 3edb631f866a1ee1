"""Operators on DataFrames: filters, recipes, combination, profiles, time series and measurement."""

"""Column functions: typing, cleaning and dates."""

"""Domain operators, DataFrame to DataFrame."""

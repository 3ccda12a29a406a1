"""Change-log operators: DataFrame to DataFrame."""

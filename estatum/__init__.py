"""File-estate analytics expressed as Spark DataFrames."""

"""Point-in-time screening of company financial statements, expressed as Spark DataFrames."""

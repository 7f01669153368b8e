"""trussline: scene analytics on PySpark DataFrames."""

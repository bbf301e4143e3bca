"""Job-market analytics on Spark DataFrames: raw postings in, demand views out."""

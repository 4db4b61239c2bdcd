"""docmill: document-extraction analytics on Spark DataFrames."""

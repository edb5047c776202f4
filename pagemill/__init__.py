"""pagemill: layout-aware multilingual document processing on Spark DataFrames."""

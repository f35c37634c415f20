"""A search-and-index analytics engine on PySpark DataFrames."""

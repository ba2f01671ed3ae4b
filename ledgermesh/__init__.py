"""Payment-network analytics on PySpark: relational, graph and ML operators on DataFrames."""

"""kinmatch: record linkage and analytics expressed with Spark DataFrames."""

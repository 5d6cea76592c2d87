"""Graph-based evidence retrieval over document collections, on Spark DataFrames."""

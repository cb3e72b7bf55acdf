"""grovekit: hierarchical clustering and cluster evaluation over Spark DataFrames."""

"""Analytics over build graphs, run histories and file accesses, as Spark DataFrames."""

"""Functions of the engine, each a plan over Spark DataFrames."""

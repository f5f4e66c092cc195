"""Code-structure analytics on Spark DataFrames: includes, syntax trees, positions, paths, logs and texts."""

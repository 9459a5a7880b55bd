"""Design-rule queries over hierarchical layout geometry, as Spark DataFrames."""

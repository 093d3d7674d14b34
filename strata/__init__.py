"""strata: graph and event analytics over fact tables, declared with Spark DataFrames and SQL."""

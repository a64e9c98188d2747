"""loomgraph: knowledge-graph analytics as Spark DataFrames."""

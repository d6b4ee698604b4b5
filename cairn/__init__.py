"""cairn: a property-graph and source-analytics engine on Spark DataFrames."""

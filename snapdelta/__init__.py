"""Two-snapshot entity and relationship diff engine on Spark DataFrames."""

"""A change-data-capture and replication engine on Spark DataFrames."""

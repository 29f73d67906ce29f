"""cairn: deduplicating snapshots and corpus preparation on Spark DataFrames."""

"""Signal analytics, metadata logs and checkpointed jobs on Spark DataFrames."""

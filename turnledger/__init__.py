"""Turn-level credit analytics for multi-turn agent rollouts, on Spark DataFrames."""

"""Evidence and cohort analytics as DataFrame-in, DataFrame-out Spark operations."""

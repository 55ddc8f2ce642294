"""Version control for datasets, as Spark DataFrame jobs over Parquet."""

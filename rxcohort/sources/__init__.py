"""CSV loading, the Parquet store, and stand-in tables."""

"""Analytics on Spark: queries over Parquet tables, log streams and ingested event tables."""

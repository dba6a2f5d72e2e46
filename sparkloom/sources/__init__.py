"""Where rows come from and go to: Parquet, SQLite files, log files, ingested tables."""

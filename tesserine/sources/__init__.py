"""Where rows come from and go to: Parquet tables, the directory walk, durable intermediate tables."""

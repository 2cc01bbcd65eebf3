"""Table sources: Parquet directories and CSV exports."""

"""Sources and sinks: pipe-delimited text (the reference's formats) and parquet."""

"""Sources and sinks: the transaction table (Parquet or any Spark format) and the rules sink."""

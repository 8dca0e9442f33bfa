"""tidegate: verified, incremental data movement and queue analytics on Spark."""

"""A notes archive on Spark: reads, change merging, reconciliation, search and snapshots."""

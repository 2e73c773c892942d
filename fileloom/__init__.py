"""Search and upkeep of large file inventories as Spark jobs."""

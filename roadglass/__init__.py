"""Connected-vehicle analytics on Spark: ingest, rules, rollups, scoring and serving queries as DataFrame jobs."""

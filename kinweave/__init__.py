"""Record linkage and incremental clustering as Spark jobs."""

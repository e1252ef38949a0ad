"""foldwise: leakage-safe supervised data processing as Spark DataFrame jobs."""

"""tieout: reconciliation and regulatory reporting as Spark DataFrame, SQL and streaming jobs."""

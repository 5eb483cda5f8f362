"""Parts-list reconciliation as Spark DataFrame jobs."""

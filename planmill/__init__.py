"""Floor-plan dataset engineering as Spark DataFrame jobs."""

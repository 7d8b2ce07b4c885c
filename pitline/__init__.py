"""Point-in-time research engine expressed as Spark DataFrame jobs."""

"""Panel analytics (entity x session) expressed as Spark DataFrame jobs."""

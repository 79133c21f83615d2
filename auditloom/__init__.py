"""Database-audit behaviour analytics expressed as Spark DataFrame jobs."""

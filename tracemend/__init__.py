"""Event-log label repair as Spark jobs."""

"""fastbreak: Spark-first analytics for event-level sports data."""

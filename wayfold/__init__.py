"""Place, event and text analytics expressed as Spark DataFrame jobs."""

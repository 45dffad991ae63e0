"""stintline: racing-season forecasting and tabular analytics as Spark jobs."""

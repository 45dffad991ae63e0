"""Plans: operators put together into queries, models and batch jobs."""

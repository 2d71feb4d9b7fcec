"""Follow-up-gap analytics on patient journeys, written for Spark."""

"""Stream-media analytics on Spark."""

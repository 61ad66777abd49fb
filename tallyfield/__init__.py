"""Site exposure and load-test log analytics as Spark DataFrame jobs."""

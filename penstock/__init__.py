"""penstock: industrial sensor anomaly detection as Spark DataFrame jobs."""

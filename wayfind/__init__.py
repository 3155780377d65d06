"""Building-sign takeoff at scale, as Spark DataFrame jobs."""

"""Building-stock energy analytics expressed as Spark DataFrame jobs."""

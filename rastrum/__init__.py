"""Image-inspection analytics expressed as Spark DataFrame jobs."""

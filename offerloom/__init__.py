"""offerloom: product-offer catalogue analytics as Spark DataFrame jobs."""

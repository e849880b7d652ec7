"""Analytics for code and text retrieval, expressed as Spark plans."""

"""strandline: market-data and document analytics as Spark DataFrame transformations."""

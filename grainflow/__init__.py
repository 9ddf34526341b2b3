"""Population analytics on Spark: measured objects grouped into ordered experiments."""

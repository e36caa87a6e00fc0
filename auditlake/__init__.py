"""Web-page audit analytics expressed as Spark DataFrame plans."""

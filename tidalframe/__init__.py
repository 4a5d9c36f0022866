"""Signal, feature and corpus analytics as Spark DataFrame transformations."""

"""A Spark-native analytics engine: relational, versioned and log analytics as DataFrame plans."""

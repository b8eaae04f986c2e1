"""A Spark-native analytics engine for epidemiologic records."""

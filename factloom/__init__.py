"""A Spark-native engine for versioned facts and the graphs they form."""

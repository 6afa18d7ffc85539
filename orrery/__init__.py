"""orrery: a Spark-native engine for searching, ranking and auditing large collections of text and code."""

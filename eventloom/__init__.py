"""eventloom: a Spark-native library that turns noisy documents into a deduplicated, date-checked event table."""

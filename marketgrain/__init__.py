"""marketgrain: Spark-native processing of retail offers, product snapshots and texts."""

"""chromalith: Spark-native analytics over single-cell chromatin-contact graphs."""

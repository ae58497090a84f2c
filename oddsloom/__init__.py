"""oddsloom: Spark-native operators over price quotes, quote histories and the texts around them."""

"""threadloom: Spark-native analytics over threaded community text."""

"""heddle: Spark-native analytics over count matrices, graphs, text and model results."""

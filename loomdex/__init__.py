"""loomdex: a Spark-native retrieval, grading and corpus-processing engine."""

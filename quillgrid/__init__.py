"""A Spark-native engine for checking documents against structured requirements."""

"""A Spark-native engine for clinical path queries and training-data curation."""

"""A PySpark-native engine for text corpora and small relational data at scale."""

"""lodestone: a PySpark-native analytics engine for source-code facts and training-data corpora."""

"""tessera: a PySpark-native engine for text search, dependency graphs, change history and corpora."""

"""A Spark-native engine that curates topic-focused corpora from already-acquired pages."""

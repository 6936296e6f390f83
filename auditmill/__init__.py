"""auditmill: a Spark-native engine for auditing web corpora."""

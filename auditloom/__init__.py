"""auditloom: a Spark-native site-audit and corpus analytics engine."""

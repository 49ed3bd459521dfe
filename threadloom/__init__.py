"""threadloom: a Spark-native engine for support-conversation analytics."""

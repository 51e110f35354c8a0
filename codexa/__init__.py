"""codexa: a PySpark-native engine for bibliographic consolidation and screening."""

"""A PySpark-native engine for building labelled text datasets at scale."""

"""A PySpark-native engine for entities, relations, history and temperature."""

"""tidemill: a PySpark-native engine for semi-structured text records."""

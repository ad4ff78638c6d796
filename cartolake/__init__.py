"""cartolake: a PySpark-native engine for place-catalogue and activity data."""

"""PySpark-native engine for time-bucketed event flow, with a corpus-preparation subpackage (`llm`)."""

"""PySpark-native analytics over discrete-outcome sequences."""

"""quern: a PySpark-native analytics engine for catalogue and document data."""

"""Spark-native analytics for extracted records: normalising, matching, scoring, curation, job tables and streams."""

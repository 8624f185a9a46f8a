"""Roomlake: Spark-native analytics over room scenes, signals and corpora."""

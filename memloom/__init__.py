"""A Spark-native engine that turns raw session transcripts into typed, searchable memory."""

__version__ = "0.1.0"

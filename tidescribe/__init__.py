"""Tidescribe: a PySpark-native engine for speech-transcript data processing."""

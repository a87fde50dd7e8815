"""Batch and streaming PySpark jobs for organisational knowledge bases."""

"""Lexiscope: corpus diagnostics written directly in Spark DataFrame operations."""

"""Structured Streaming jobs: raw landing, bronze append, silver upsert."""

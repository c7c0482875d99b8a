"""Structured Streaming counterparts; beyond what batch plans need."""

"""Structured Streaming entry points (file-triggered month refresh)."""

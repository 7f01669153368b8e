"""Streaming: job queue and frame state over Structured Streaming."""

"""Structured Streaming order pipeline."""

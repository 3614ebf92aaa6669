"""Stateful playback over Structured Streaming."""

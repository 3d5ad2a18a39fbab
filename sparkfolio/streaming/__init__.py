"""Structured Streaming: file events to documents, governance events to decisions, windows over events."""

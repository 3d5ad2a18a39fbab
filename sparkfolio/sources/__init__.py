"""Readers and writers."""

from .files import append_events, event_stream, events, latest_events, read_files, read_metadata, read_table, write_table
from .log import EventLog, log_stream

__all__ = ["EventLog", "append_events", "event_stream", "events", "latest_events", "log_stream", "read_files", "read_metadata", "read_table", "write_table"]

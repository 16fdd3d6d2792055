"""Structured Streaming: the stateless dataset operators on a file stream."""

from panelscope.streaming.labels import run_available, stream_labels

__all__ = ["run_available", "stream_labels"]

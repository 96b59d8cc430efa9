"""Structured Streaming: drift per micro-batch against a reference table."""

from driftwise.streaming.monitor import drift_stream, read_stream_results

__all__ = ["drift_stream", "read_stream_results"]

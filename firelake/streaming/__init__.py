"""Structured Streaming ingest."""

from firelake.streaming.ingest import Feed, detection_feed, hms_feed, poll_once, start_feed, stream_dedup

__all__ = ["Feed", "detection_feed", "hms_feed", "poll_once", "start_feed", "stream_dedup"]

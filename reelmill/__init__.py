"""Streaming-media analytics on Spark: manifests, transport streams and playback telemetry as DataFrames."""

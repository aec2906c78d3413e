"""The same landing and merge steps driven by Structured Streaming."""

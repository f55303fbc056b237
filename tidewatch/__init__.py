"""Security-event analytics as DataFrame and Structured Streaming jobs."""

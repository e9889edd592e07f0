"""The same transforms under Structured Streaming."""

"""File-incremental jobs on Structured Streaming."""

"""Change capture and incremental maintenance, in batch and on Structured Streaming."""

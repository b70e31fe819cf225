"""Live results over change streams with Structured Streaming."""

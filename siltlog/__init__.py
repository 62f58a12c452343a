"""Search and ingestion of log events on Spark: events are rows, a query compiles to one Column, tailing is Structured Streaming."""

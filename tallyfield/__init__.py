"""Match-evidence and web-traffic analytics as Spark jobs."""

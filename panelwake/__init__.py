"""Event-panel analytics as Spark jobs."""

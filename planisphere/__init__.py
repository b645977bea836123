"""Two-dimensional maps of embedding tables, computed as Spark jobs."""

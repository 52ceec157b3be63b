"""Log-template mining and corpus preparation as Spark jobs."""

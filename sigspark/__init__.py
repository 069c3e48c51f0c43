"""sigspark: biosignal and event-stream analytics as Spark DataFrame transforms."""

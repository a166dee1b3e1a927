"""Text and embedding analytics as Spark DataFrame functions."""

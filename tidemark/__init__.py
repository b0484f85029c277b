"""Order-event analytics on Spark: the same DataFrame functions for tables and streams."""

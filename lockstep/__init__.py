"""Keep two keyed collections of nested JSON objects in step, on Spark."""

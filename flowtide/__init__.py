"""Flow-sequence analytics on Spark: packets to flows, prefix scores, early decisions, drift."""

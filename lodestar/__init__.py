"""Asset-registry, sparse-tensor and run-telemetry analytics on Spark DataFrames."""

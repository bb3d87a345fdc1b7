"""millrace: table and stream operators for profiling, synthesis, conformance and data flows on Spark."""

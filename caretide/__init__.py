"""Clinical-triage analytics on Spark: text masking, JSON validation, model routing,
protocol retrieval, approval state, audit ingestion and service-level reporting."""

"""Fleet-telemetry analytics on Spark: cleaning, enrichment, SQL packs, streaming, features and corpus operators."""

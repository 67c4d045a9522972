"""Account-renewal analytics on Spark: features, validation, splits, metrics, scoring, explanation, drift and request monitoring."""

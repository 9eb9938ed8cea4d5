"""Transaction-risk analytics on Spark: features, scoring, evaluation, alerting, monitoring."""

"""Document-review analytics on Spark: drawings, their findings, and corpus preparation."""

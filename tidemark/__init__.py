"""tidemark: market time-series jobs and corpus jobs as Spark DataFrame functions."""

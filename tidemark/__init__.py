"""Cross-sectional panel and time-series analytics as DataFrame-to-DataFrame functions on Spark."""

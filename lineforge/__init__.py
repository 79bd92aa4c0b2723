"""Log-shape, log-parsing and metric-alert analytics as Spark DataFrame transforms."""

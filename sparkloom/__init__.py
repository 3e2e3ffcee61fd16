"""Method metrics of JavaScript sources, and data processing around them, on Spark."""

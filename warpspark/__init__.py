"""Shape-based clustering and classification of series on Spark."""

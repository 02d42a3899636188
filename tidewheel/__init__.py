"""Very large sliding and day-cumulative windows on Spark."""

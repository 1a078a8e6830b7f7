"""Model selection over tables and analytics over the runs it produces, on Spark."""

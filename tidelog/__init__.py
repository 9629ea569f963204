"""tidelog: versioned key-value change logs, their state and their statistics, on Spark."""

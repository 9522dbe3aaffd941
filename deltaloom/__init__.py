"""Analytics over source-code history as DataFrame operators on Spark."""

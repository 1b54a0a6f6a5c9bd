"""Analytics over personal ledgers, written for Spark."""

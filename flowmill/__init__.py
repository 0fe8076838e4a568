"""Message-flow analytics on Spark: routing, limits, expiry, settlement and recovery as DataFrame operators."""

"""penlake: Spark DataFrame operators for ordered pen-stroke and token-sequence data."""

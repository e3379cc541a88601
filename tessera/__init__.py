"""A multilingual content lakehouse on Spark: identity, observations, segments, and the stores that hold them."""

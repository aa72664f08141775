"""Reading, landing and writing partitioned data."""

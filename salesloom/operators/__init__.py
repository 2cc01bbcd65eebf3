"""DataFrame operators that Spark does not spread over a cluster by itself."""

"""DataFrame-in, DataFrame-out operators for gridded environmental tables on Spark."""

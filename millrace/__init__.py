"""DataFrame-in, DataFrame-out operators for preference records and text corpora on Spark."""

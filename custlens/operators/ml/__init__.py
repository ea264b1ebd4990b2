"""Model search, training and prediction on pyspark.ml (J, L)."""

"""custlens: Spark-native customer analytics (RFM, segmentation, CLV) and
tabular model search, written on the PySpark DataFrame / SQL / pyspark.ml /
Structured Streaming APIs."""

__version__ = "0.1.0"

"""Text counting and random forests on Spark: DataFrame functions and pyspark.ml."""

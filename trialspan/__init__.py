"""Spark-native analytics for trial-by-trial behavioural sessions and the text corpora built from them."""

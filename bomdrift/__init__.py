"""Component-consumption variance on Spark: DataFrame functions and the jobs that compose them."""

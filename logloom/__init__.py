"""Log-template analytics on Spark: learn, classify, judge and report log lines."""

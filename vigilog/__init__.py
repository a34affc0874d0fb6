"""Log threat detection on Spark: parse, featurise, apply rules, score, fuse, report."""

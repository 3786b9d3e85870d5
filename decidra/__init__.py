"""decidra: a Spark-first engine for analysing typed, calibrated decisions."""

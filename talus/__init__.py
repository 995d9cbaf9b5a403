"""Analytics engine for alert processing and training-data preparation on PySpark."""

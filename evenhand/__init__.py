"""evenhand: model-fairness analytics on Spark DataFrames and streams."""

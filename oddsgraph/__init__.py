"""Logical-coherence analytics for prediction-market prices, on Spark.

Every public function takes and returns DataFrames (or Columns); nothing here
collects data rows to the driver.
"""

"""Demand-forecasting analytics expressed as Spark DataFrame plans."""

"""Evaluation of daily cross-sectional signals as Spark DataFrame plans."""

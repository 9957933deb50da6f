"""Grainmill: DataFrame-to-DataFrame operators for tabular analytics and feature engineering on Spark."""

"""Preparation, checking and modelling of sensor time series on Spark."""

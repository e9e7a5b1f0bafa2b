"""Operators: functions from DataFrames to DataFrames over the activity tables."""

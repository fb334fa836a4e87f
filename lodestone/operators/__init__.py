"""Operators: functions from a graph and parameters to a DataFrame."""

"""Operators over points, cells, aisles and routes: functions from DataFrames to DataFrames."""

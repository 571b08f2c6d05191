"""Vantor: entity intelligence over DataFrames, built for Spark's own planner."""

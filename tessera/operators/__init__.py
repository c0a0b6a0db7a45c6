"""Operators on DataFrames: key-value tables, metrics, learning, simulation, assignment, folds, traces."""

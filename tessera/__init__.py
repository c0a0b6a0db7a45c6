"""tessera: a Spark-first analytics engine.

Key-value tables with TTL, mergeable metrics, windows and series, learning and
simulation operators, assignment, ordered folds, codecs and scalar functions,
all declared on DataFrames so that Catalyst picks the physical plan.
"""

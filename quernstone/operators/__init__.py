"""Operators over DataFrames: index build, ranking, graphs, diffs, risk, nested records."""

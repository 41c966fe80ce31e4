"""Operators on keyed relations: pixels, paths, graphs, labels, predictions. Each maps DataFrames to a DataFrame."""

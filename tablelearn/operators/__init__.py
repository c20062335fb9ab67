"""Operators: fit/transform/predict over feature DataFrames."""

"""Operators of a training-data pipeline, one module each; `queries` registers them.

Nothing else in the package imports this folder.
"""

"""Operators for training data, problems 1 to 8.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""

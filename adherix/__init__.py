"""Spark-native code and text adherence analytics.

The reference-shaped operators (rule scan, classification, similarity,
aggregation, reports, training pairs) live in ``functions``, ``operators``,
``sources``, ``plans`` and ``streaming``.  The training-data operators live in
the subpackage ``llm``, which nothing else imports.
"""

__version__ = "0.1.0"

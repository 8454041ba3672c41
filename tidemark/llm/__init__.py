"""Operators for preparing large-model training corpora with Spark.

Nothing outside this subpackage imports it.
"""

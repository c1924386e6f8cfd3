"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  Operators take and return DataFrames; Python code that
runs on executors is imported there by module name, so the package must be on their PYTHONPATH
(``spark.submit.pyFiles`` or an installed wheel).
"""

"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` registers the thin queries over
the test tables and their DuckDB SQL.  Executors import the package, so a
cluster job ships it (``--py-files``) or installs it.
"""

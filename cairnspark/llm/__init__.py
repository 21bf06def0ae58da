"""Operators for preparing language-model training data.

Each module holds one operator with a general interface.  Nothing outside this
subpackage imports it; ``queries.py`` lists the registered queries and
``oracle.py`` their SQL.
"""

"""Operators for preparing language-model training corpora.

Nothing else in the library imports this package; it may be removed and the
rest keeps working.  ``queries.py`` holds the registered queries and
``oracle.py`` their SQL, where SQL can express them.
"""

"""Training-data operators.

Thirteen operators that prepare text corpora for model training. Nothing else in
the library imports this subpackage; its queries are in ``queries.py``.
"""

"""Training-data operators: ten numbered operators and their registered queries.

Nothing outside this subpackage imports it.
"""

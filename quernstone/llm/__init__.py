"""Operators for preparing large text corpora: ten independent modules and their queries.

Nothing outside this subpackage imports it; ``queries`` holds the query and SQL registry.
"""

"""Training-data operators: thirteen document-scale operators and the queries that apply them.

Nothing outside this subpackage imports it; ``lodestar.llm.queries`` holds the query registry.
"""

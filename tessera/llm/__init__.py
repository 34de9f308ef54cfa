"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` in
``tessera.llm.registry`` list what it registers.
"""

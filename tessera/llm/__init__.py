"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; :mod:`tessera.llm.queries` derives the thin
``opN_<name>`` queries from them.
"""

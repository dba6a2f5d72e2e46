"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; its queries are listed in
``sparkloom.llm.queries``.
"""

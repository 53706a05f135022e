"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``tracewright.llm.entry`` holds the
registered queries and their SQL.
"""

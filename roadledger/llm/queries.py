"""The queries of all operators of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from roadledger.llm import decontaminate, htmltext, langid, neardup, pieces, pii, quality, search, substrings, warc

_MODULES = (substrings, pii, htmltext, search, warc, neardup, langid, quality, pieces, decontaminate)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}

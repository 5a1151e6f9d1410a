"""How queries are named and paired with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: ``documents`` as items, in DuckDB's SQL.
ITEMS = """items AS (SELECT sha256('["default","' || doc_id || '"]') AS record_id, doc_id::VARCHAR AS item_id, text, doc_id + 1 AS arrival_seq, replace(text, chr(13) || chr(10), chr(10)) AS norm, source, lang FROM documents)"""
#: Distinct features of every item, and their hashes.
FEATURES = (
    ITEMS
    + """, grams AS (SELECT DISTINCT record_id, 'char' AS kind, f FROM (SELECT record_id, CASE WHEN length(norm) < 3 THEN norm ELSE substr(norm, i, 3) END AS f FROM (SELECT record_id, norm, unnest(range(1, greatest(length(norm) - 1, 2))) AS i FROM items WHERE trim(norm, chr(9) || chr(10) || chr(13) || ' ') <> ''))),
toks AS (SELECT DISTINCT record_id, 'token' AS kind, unnest(regexp_extract_all(norm, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS f FROM items),
feats AS (SELECT * FROM grams UNION ALL SELECT * FROM toks)"""
)

"""How queries and their oracles are registered, and SQL that oracles share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_D = "WITH d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text))::BIGINT AS n FROM documents) "
_S = """s AS (SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS idx, l_quantity::BIGINT AS size FROM lineitem)"""


def _h(at: int, *order: int) -> str:
    """SQL for the number whose hex digits are the bytes at a place in the given order."""
    return "('0x' || " + " || ".join(f"substr(h, {2 * (at + k) + 1}, 2)" for k in order) + ")"

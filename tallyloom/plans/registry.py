"""The registry of queries, and SQL that many of them share."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}

# SQL of what many queries share.
NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
PRINT = f"sha1({NORM})"
HEX8 = "('0x' || substr({0}, 1, 8))::BIGINT"


def order_sql(seed, *parts: str) -> str:
    return f"sha1(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"


def mod_sql(key: str, m: int) -> str:
    out = "0"
    for i in range(5):
        out = f"(({out}) * {2**32 % m} + ('0x' || substr(sha1({key}), {1 + 8 * i}, 8))::BIGINT % {m}) % {m}"
    return out


def query(sql: str | None = None):
    """Register a function of a table reader `t`, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put

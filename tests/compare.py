"""Rows of Spark and DuckDB as sorted texts, floats to six digits."""

import math


def _cell(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return int(x) if x == int(x) else round(x, 6)
    return x


def rows_of(df, columns):
    return sorted(repr(tuple(_cell(r[c]) for c in columns)) for r in (x.asDict() for x in df.collect()))


def rows_of_duck(relation, columns):
    names = relation.columns
    return sorted(repr(tuple(_cell(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in relation.fetchall())


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    assert rows_of(df, columns) == rows_of_duck(relation, columns)

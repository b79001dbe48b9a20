"""Loose formats that no built-in function reads: Python literals, JSON inside other text, HTML entities."""

from __future__ import annotations

import ast
import html
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _literal(x: str | None) -> str | None:
    if x is None:
        return None
    try:
        return json.dumps(json.loads(x), ensure_ascii=False)
    except ValueError:
        pass
    try:
        return json.dumps(ast.literal_eval(x), ensure_ascii=False)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def _embedded(x: str | None, mark: str | None) -> str | None:
    if x is None or mark is None or mark not in x:
        return None
    rest = x[x.index(mark) + len(mark) :].lstrip()
    try:
        return json.dumps(json.JSONDecoder().raw_decode(rest)[0], ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def json_or_literal(x: pd.Series) -> pd.Series:
    """JSON of a text that is JSON or a Python literal, else null."""
    return x.map(_literal)


@F.pandas_udf(StringType())
def embedded_json(x: pd.Series, mark: pd.Series) -> pd.Series:
    """The first JSON value after a mark, whatever follows it, else null."""
    return pd.Series([_embedded(a, b) for a, b in zip(x, mark, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """Text with all HTML entities as characters."""
    return x.map(lambda s: None if s is None else html.unescape(s))

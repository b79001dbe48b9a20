"""Stable ids, hash splits and hash order. Random choices are orders by hash of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(x: Column) -> Column:
    """A key part as text; null is a part of its own."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *map(as_text, parts))), 1, 16)


def order_key(seed: int | str, *parts: Column) -> Column:
    """A key whose order is a shuffle by the seed."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *map(as_text, parts)))


def hash_mod(key: Column, modulus: int) -> Column:
    """The whole SHA-1 of a text modulo a number below 2**31, folded over five parts of 32 bits."""
    digest = F.sha1(key)
    rest = F.lit(0).cast("long")
    for i in range(5):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        rest = (rest * (2**32 % modulus) + part % modulus) % modulus
    return rest


def hash_bucket(*parts: Column, mod: int = 100) -> Column:
    """The first 32 bits of the SHA-1 of the parts joined by bars, modulo `mod`."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *map(as_text, parts))), 1, 8), 16, 10).cast("long") % mod


def uniform(seed: int | str, *parts: Column) -> Column:
    """A number from 0 to below 1 by hash."""
    return F.conv(F.substring(order_key(seed, *parts), 1, 8), 16, 10).cast("double") / float(2**32)


def split_of(key: Column, test: int = 1, validation: int = 1, out_of: int = 10) -> Column:
    """test, validation or train by the hash of a key."""
    at = hash_mod(key, out_of)
    return F.when(at < test, "test").when(at < test + validation, "validation").otherwise("train")

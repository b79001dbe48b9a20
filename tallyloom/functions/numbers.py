"""Numbers in texts: their value, magnitude and unit, and numbers near another one."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.binding import bound
from tallyloom.functions.hashing import order_key

#: Words and letters behind a number that multiply it; `%` and currencies are its unit.
MAGNITUDES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12}
CURRENCIES = "$€£¥"

def _pattern(currency: str) -> str:
    """A number, with `currency` behind its sign. It is not inside a word, a longer number or a date; a minus sign belongs to it unless something stands before."""
    words = "|".join(MAGNITUDES)
    return rf"(?i)(?=[-{CURRENCIES}\d])(?<![\w.,/])(?<!\d-)-?{currency}-?(?:\d{{1,3}}(?:,\d{{3}})+(?![\d])|\d+)(?:\.\d+)?(?!\d|[.,/-]\d)(?:\s?(?:%|(?:{words})(?!\w)))?(?![^\W\d_])"


#: Values near another one, as (class, factor, steps of its last digit, only for small values). Lower classes come first; in a class, hash order.
NEAR = [
    *[(1, 1.0, s, True) for s in (1,)],
    *[(2, f, 0, False) for f in (0.5, 0.8, 0.9, 0.95, 1.05, 1.1, 1.2, 2.0)],
    *[(3, f, 0, False) for f in (-1.0, 0.1, 10.0)],
    *[(4, 1.0, s, True) for s in (-2, -1, 2)],
]
#: Fixed value: steps of its last digit below which a value is small.
SMALL = 50


def numbers_in(text: Column, currency: str | None = None) -> Column:
    """(value, decimals, unit, raw) of the numbers of a text in order: `$3.2 million`, `-1,234.50`, `12%`, `4k`. The unit is `%`, a currency or empty; parts of words, dates and versions are no numbers. With a currency only the numbers of that unit, for which no others are read."""
    if currency is not None and (len(currency) != 1 or currency not in CURRENCIES):
        raise ValueError(f"not a currency: {currency}")
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_pattern(f"[{currency or CURRENCIES}]" + "?" * (not currency))), 0)
    if currency:
        raw = F.filter(raw, lambda x: ~F.endswith(x, F.lit("%")))
    return F.transform(raw, _read)


_BLANKS = " \t\n\x0b\f\r"


def _read(raw: Column) -> Column:
    """(value, decimals, unit, raw) of a text that is one number: sign and currency, digits with commas and decimals, a magnitude or `%`."""
    digits = F.rtrim(raw, F.lit(_BLANKS + string.ascii_letters + "%"))
    behind = F.lower(F.ltrim(F.substring(raw, F.length(digits) + 1, F.length(raw)), F.lit(_BLANKS)))
    plain = F.ltrim(F.replace(digits, F.lit(","), F.lit("")), F.lit("-" + CURRENCIES))
    point = F.instr(plain, ".")
    times = F.when(behind == "", 1.0)
    for word, by in MAGNITUDES.items():
        times = times.when(behind == word, by)
    value = F.when(F.contains(raw, F.lit("-")), -1.0).otherwise(1.0) * plain.cast("double") * times.otherwise(1.0)
    first = F.left(F.ltrim(digits, F.lit("-")), F.lit(1))
    unit = F.when(behind == "%", "%").when(first.isin(*CURRENCIES), first).otherwise("")
    return F.struct(value.alias("value"), F.when(point > 0, F.length(plain) - point).otherwise(0).alias("decimals"), unit.alias("unit"), raw.alias("raw"))


def related_to(gold: Column, numbers: Column, unit: Column | str = "") -> Column:
    """The other values among numbers (see `numbers_in`) of a unit, each once: those nearest to gold by the logarithm of their ratio first, then the smaller; a zero is as far as can be."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    own = F.array_distinct(F.transform(F.filter(numbers, lambda x: (x["unit"] == unit) & (x["value"] != gold)), lambda x: x["value"]))
    far = lambda v: F.when((v == 0) | (gold == 0), F.lit(float("inf"))).otherwise(F.abs(F.log(F.abs(v) / F.abs(gold))))
    return F.transform(F.sort_array(F.transform(own, lambda v: F.struct(far(v).alias("far"), v.alias("v")))), lambda s: s["v"])


def near_values(gold: Column, decimals: int, seed: int, *key: Column) -> Column:
    """Values near gold by the rules of NEAR, by class and then in hash order of the seed, the key and the rule."""
    step = 10.0**-decimals
    small = F.abs(gold) < SMALL * step
    name = lambda f, s: str(f) if f != 1.0 else f"{s:+d}"
    rules = [F.when(small | F.lit(not only), F.struct(F.lit(c).alias("class"), order_key(seed, *key, F.lit(name(f, s))).alias("h"), (gold * f + s * step).alias("v"))) for c, f, s, only in NEAR]
    return F.transform(F.sort_array(F.filter(F.array(*rules), lambda r: r.isNotNull())), lambda r: r["v"])


def number_choices(gold: Column, decimals: int, n: int, seed: int, *key: Column, related: Column | None = None, unit: str = "") -> Column:
    """Gold first, then n - 1 other numbers as texts like it: related ones in their order, then near ones. All texts differ; null if there are too few."""
    shown = lambda vs: F.transform(vs, lambda v: F.concat(F.format_number(v, decimals), F.lit(unit)))
    own = F.array(gold) if related is None else F.concat(F.array(gold), F.coalesce(related, F.array().cast("array<double>")))
    # Near values are made only where related ones are too few.
    more = lambda own: F.array_distinct(F.concat(own, shown(near_values(gold, decimals, seed, *key))))
    every = bound(F.array_distinct(shown(own)), lambda own: F.slice(F.when(F.size(own) >= n, own).otherwise(more(own)), 1, n))
    return F.get(F.filter(F.array(every), lambda few: F.size(few) == n), 0)

"""Checking the claims of a note against the evidence that it was written from.

A note is a text; its evidence is the text that was printed for the writer and the exact values
behind it, by name. Every number of a note must be one that was printed, or an exact value at
the precision that the note writes, or such a value in the unit that the note names. A place in
time must lie near the closest approach. All claims are checked, and each violation is a row.
Everything is an expression, so notes are checked where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far from the closest approach a claim may point, as a share of the pass and in seconds.
TOLERANCE_SHARE, TOLERANCE_SECONDS = 0.10, 5.0

NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
UNIT = r"(?i:\s*(?:(megahertz|mhz|kilohertz|khz|hertz|hz|percent)\b|(%)))"
CODE = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
#: Numbers that stand for a place in time, in seconds or as a share of the pass.
SECONDS = [r"(?i)\b([\d.,]*\d)[- ](?:seconds?|s)[- ]mark\b", r"(?i)\b([\d.,]*\d) ?(?:seconds?|s) into the\b", r"(?i)\bt ?= ?([\d.,]*\d) ?s\b"]
SHARE = r"(?i)\b(?:at|near|around) (0?\.\d+|[01]) of the (?:pass|recording)\b"
_FACTORS = {"mhz": 1e-6, "megahertz": 1e-6, "khz": 1e-3, "kilohertz": 1e-3}


def _plain(literal: Column) -> Column:
    return F.regexp_replace(literal, "[,+]", "")


def numbers(text: Column) -> Column:
    """Array of (literal, unit) of all numbers; the unit in lower case, empty without one."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})(?:{UNIT})?"), F.lit(0))

    def parts(x: Column) -> Column:
        literal = F.regexp_extract(x, f"^{NUMBER}", 0)
        unit = F.lower(F.trim(F.substring(x, F.length(literal) + 1, F.length(x))))
        return F.struct(literal.alias("literal"), unit.alias("unit"))

    return F.transform(found, parts)


def _equals(value: Column, literal: Column) -> Column:
    """Whether the value, rounded half to even at the literal's places, is the literal."""
    plain = _plain(literal)
    scale = F.pow(F.lit(10.0), F.when(plain.contains("."), F.length(F.substring_index(plain, ".", -1))).otherwise(0))
    return F.rint(value * scale) == F.rint(plain.cast("double") * scale)


def is_grounded(number: Column, printed: Column, values: Column, shares: list[str]) -> Column:
    """Whether a number (literal, unit) can be traced to the evidence (O14.4).

    printed: the text; values: map of names to exact values, of which names ending in _hz may be
    written in kilohertz or megahertz and those in `shares` in percent.
    """
    literal, unit = number["literal"], number["unit"]
    tokens = F.transform(numbers(printed), lambda n: n["literal"])
    factor = F.lit(None).cast("double")
    for name, f in _FACTORS.items():
        factor = F.when(unit == name, F.lit(f)).otherwise(factor)

    def meant(entry: Column) -> Column:
        name, exact = entry["key"], entry["value"]
        converted = name.endswith("_hz") & F.coalesce(_equals(exact * factor, literal), F.lit(False))
        share = name.isin(shares) & unit.isin("%", "percent") & _equals(exact * 100.0, literal)
        return F.coalesce(_equals(exact, literal) | converted | share, F.lit(False))

    return F.array_contains(tokens, literal) | F.exists(F.map_entries(values), meant)


def time_claims(text: Column, duration: Column, closest: Column) -> Column:
    """Array of (literal, unit) of places in time that are too far from the closest approach, a share of the pass (O14.5).

    Without a duration or a closest approach nothing can be said. A duration is no place.
    """
    tolerance = F.greatest(F.lit(TOLERANCE_SHARE) * duration, F.lit(TOLERANCE_SECONDS))
    none = F.array().cast("array<struct<literal:string,unit:string>>")
    far = lambda x, at, most: F.abs(_plain(x).cast("double") - at) > most
    claim = lambda unit: lambda x: F.struct(x.alias("literal"), F.lit(unit).alias("unit"))
    found = [F.transform(F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: far(x, closest * duration, tolerance)), claim("s")) for p in SECONDS]
    found.append(F.transform(F.filter(F.regexp_extract_all(text, F.lit(SHARE), F.lit(1)), lambda x: far(x, closest, F.lit(TOLERANCE_SHARE))), claim("fraction")))
    return F.when((duration > 0) & closest.isNotNull(), F.array_distinct(F.flatten(F.array(*found)))).otherwise(none)


def violations(notes: DataFrame, key: str, text: str, printed: str, values: str, shares: list[str], duration: str, closest: str) -> DataFrame:
    """key, code, literal, unit: every claim of a note that its evidence does not bear out (O14.3).

    values: map of exact values; duration and closest: names in it. An empty note is one
    violation; a code word must stand in the printed evidence.
    """
    body, seen = F.trim(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(printed), F.lit(""))
    row = lambda code, x: F.struct(F.lit(code).alias("code"), x["literal"].alias("literal"), x["unit"].alias("unit"))
    loose = F.filter(numbers(body), lambda n: ~is_grounded(n, seen, F.col(values), shares))
    codes = F.array_except(F.regexp_extract_all(body, F.lit(CODE), F.lit(0)), F.regexp_extract_all(seen, F.lit(CODE), F.lit(0)))
    blank = F.struct(F.lit("EMPTY").alias("code"), F.lit("").alias("literal"), F.lit("").alias("unit"))
    found = F.concat(
        F.when(body == "", F.array(blank)).otherwise(F.array().cast("array<struct<code:string,literal:string,unit:string>>")),
        F.transform(loose, lambda n: row("UNGROUNDED_NUMBER", n)),
        F.transform(time_claims(body, F.col(values)[duration], F.col(values)[closest]), lambda n: row("MISLOCATED_TIME_CLAIM", n)),
        F.transform(codes, lambda c: F.struct(F.lit("UNGROUNDED_ENTITY").alias("code"), c.alias("literal"), F.lit("").alias("unit"))),
    )
    return notes.select(key, F.explode(found).alias("v")).select(key, "v.*")

"""Secret scans by a trigram inverted index.

For each rule's regex the planner derives a Boolean query over trigrams: an OR of clauses,
each an AND of trigrams that any match must hold. The index has a posting (text key,
trigram) for each trigram of the rules that a text holds; a clause's postings are
intersected by OR-ing one bit per trigram over the text key, and a text whose mask is full
is a candidate. Only candidates are searched with the regex. Rules without mandatory
trigrams scan every text. Candidates are counted; up to a million (a key and a mask of rules
each, 16 bytes) are broadcast to the texts, more are joined by an exchange.

The index is keyed by the text's hash, not by the row: copies share postings, a hash
collision only adds a candidate, and ids may repeat or be null.

Defined results: null text is empty and has no secrets; positions are code points, end
exclusive; matches are leftmost and do not overlap within a kind; a match whose measured
group is too short is dropped; a very long text is searched whole, by one task; an empty
table gives no rows; other columns pass, whatever their names (one named as `out` is replaced).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlane.functions.materialize import attach
from reviewlane.llm.common import aside, own, restored, sums_before, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: read alike by Java and Python. group: the group of which `least` characters are asked."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _any_case(pattern: str) -> str:
    """The pattern with each letter as a class of its two cases: no other sign folds to one of them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


# The base rules, then public credential formats.
RULES = [
    Rule("assign", rf"""({_any_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_git", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{0,30}://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
]
BASE = ["assign", "access", "hex"]

_MANY = 64  # strings that a node may spell out before only its trigrams are kept


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


class _Query:
    """What a part of a regex is sure to hold: exact strings (None: unknown) and clauses in OR form."""

    def __init__(self, exact: set[str] | None, clauses: frozenset[frozenset[str]] = frozenset([frozenset()])):
        self.exact, self.clauses = exact, clauses


def _both(a, b):
    joined = frozenset(x | y for x, y in product(a, b))
    return joined if len(joined) <= _MANY else min((a, b), key=lambda c: (frozenset() in c, len(c)))


def _flush(exact: set[str]) -> frozenset[frozenset[str]]:
    return frozenset(_grams(x) for x in exact)


def _sequence(items, ignore: bool) -> _Query:
    run, clauses, whole = {""}, frozenset([frozenset()]), True
    for item in items:
        part = _node(item, ignore)
        if part.exact is not None and len(run) * len(part.exact) <= _MANY:
            run = {x + y for x in run for y in part.exact}
            continue
        clauses, whole = _both(_both(clauses, _flush(run)), part.clauses), False
        run = {""}
        if part.exact is not None:
            run = part.exact
    if whole:
        return _Query(run, _flush(run))
    return _Query(None, _both(clauses, _flush(run)))


def _node(item, ignore: bool) -> _Query:
    op, value = str(item[0]), item[1]
    if op == "LITERAL":
        return _Query({chr(value).lower()})
    if op == "IN":
        found = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                found.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 16:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return _Query(None)
        return _Query(found) if len(found) <= 16 else _Query(None)
    if op == "SUBPATTERN":
        return _sequence(value[3], ignore)
    if op == "BRANCH":
        parts = [_sequence(x, ignore) for x in value[1]]
        if all(p.exact is not None for p in parts):
            exact = set().union(*(p.exact for p in parts))
            return _Query(exact, _flush(exact))
        return _Query(None, frozenset().union(*(p.clauses for p in parts)))
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        part = _sequence(inner, ignore)
        if (low, high) == (0, 1) and part.exact is not None:
            return _Query(part.exact | {""})
        if low == 0:
            return _Query(None)
        return part if (low, high) == (1, 1) else _Query(None, part.clauses if part.exact is None else _flush(part.exact))
    return _Query(None)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses (lower case): a match holds all trigrams of one of them. Empty: no trigram is mandatory."""
    found = _sequence(re._parser.parse(pattern), False)
    if any(not c for c in found.clauses):
        return []
    # A clause that holds another asks for more and adds nothing to the OR.
    return sorted((c for c in found.clauses if not any(o < c for o in found.clauses)), key=sorted)


def _clause_table(rules: list[Rule]) -> list[tuple[str, int, str, int, int]]:
    """(rule, clause, trigram, bit, full mask)."""
    rows = []
    for rule in rules:
        for n, clause in enumerate(trigram_query(rule.pattern)):
            grams = sorted(clause)[:62]
            rows += [(rule.kind, n, g, 1 << i, (1 << len(grams)) - 1) for i, g in enumerate(grams)]
    return rows


def build_index(documents: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Postings (key, gram): which of the rules' trigrams each text holds."""
    grams = sorted({row[2] for row in _clause_table(rules)})
    low = documents.select(F.xxhash64(text_or_empty(F.col(text))).alias("key"), F.lower(text_or_empty(F.col(text))).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("key", F.explode(present).alias("gram"))


def candidates(postings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(key, may): the rules that a text may match, a bit for each in their order, by intersecting postings."""
    clauses = postings.sparkSession.createDataFrame(_clause_table(rules), "kind string, clause int, gram string, bit long, full long")
    met = (
        postings.join(F.broadcast(clauses), "gram")  # one row per rule, clause and trigram
        .groupBy("key", "kind", "clause", "full")
        .agg(F.bit_or("bit").alias("mask"))
        .where("mask = full")
    )
    bit = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, 1 << i)))
    return met.groupBy("key").agg(F.bit_or(F.element_at(bit, F.col("kind"))).alias("may"))


def _found(text: Column, rule: Rule) -> Column:
    """Array of (start, order, end, kind) of one rule's matches."""
    whole = f"({rule.pattern})"
    matches = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    measured = F.regexp_extract_all(text, F.lit(whole), F.lit(rule.group + 1)) if rule.group else matches
    between = F.split(text, rule.pattern)
    order = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    sizes = F.zip_with(
        F.slice(F.transform(between, F.length), 1, F.size(matches)),
        F.zip_with(matches, measured, lambda m, v: F.struct(F.length(m).alias("size"), F.length(v).alias("measure"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["size"].alias("size"), m["measure"].alias("measure")),
    )

    def spans(steps: Column) -> Column:
        before = sums_before(F.transform(steps, lambda x: x["gap"] + x["size"]))

        def span(x: Column, at: Column) -> Column:
            start = (at + x["gap"]).cast("int")
            return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"), x["measure"].alias("measure"))

        kept = F.filter(F.zip_with(steps, before, span), lambda s: s["measure"] >= rule.least)
        return F.transform(kept, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "order", "end", "kind"))))

    return F.transform(F.array(sizes), spans)[0]


def scan(documents: DataFrame, rules: list[Rule] = RULES, text: str = "text", out: str = "secrets") -> DataFrame:
    """documents with `out`: array of (start, order, end, kind), sorted by start and then by the rules' order (a column of that name is replaced)."""
    held = aside(documents)
    body = own(documents, text)
    keyed = held.withColumn("key", F.xxhash64(text_or_empty(F.col(body))))
    joined = attach(keyed, candidates(build_index(held, rules, body), rules), ["key"], "left")
    whole = text_or_empty(F.col(body))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    parts = []
    for i, rule in enumerate(rules):
        # Not null for texts without any candidate: a null would let the regex run on them.
        may = F.coalesce(F.col("may"), F.lit(0)).bitwiseAND(1 << i) > 0 if trigram_query(rule.pattern) else F.lit(True)
        parts.append(F.when(may & F.rlike(whole, F.lit(rule.pattern)), _found(whole, rule)).otherwise(none))
    return joined.select(*restored(joined, documents, (out,)), F.sort_array(F.flatten(F.array(*parts))).alias(out))


def digest(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by the mask."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(s, x):
        ahead = F.concat(s["text"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], ahead).otherwise(s["text"]).alias("text")
        )

    tail = F.aggregate(
        spans, state, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, tail).otherwise(text)

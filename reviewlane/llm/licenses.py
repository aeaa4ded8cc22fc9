"""License scans: an Aho-Corasick automaton finds phrases and tags, a shunting-yard parser reads expressions.

A text is brought to lower-case words joined by one space; one pass of the automaton over
it finds every place where a phrase's words stand consecutively, and identifier tags. Only
a text with a tag is read again: the expression after each tag is turned to postfix order
by the shunting-yard rule (WITH binds before AND before OR, parentheses group) and
evaluated to the labels it names and to whether its terms can be met by permissive
licenses alone. Operators are in upper case, or in lower case inside parentheses; the
expression ends before a word that can be neither an operator nor an identifier, and an
operator before such a word is prose too.

Defined results: null text has no words; a broken expression gives the labels of the
identifiers that it names; n_base counts all places of base phrases, overlapping ones too;
score is the strength of the best evidence (1: a tag, 0.9: a full notice, 0.6: a short
name, 0: none), halved if every expression found needs a license that is not permissive;
rows are independent, so repeated rows, null ids and other columns do not matter (columns
named as the FIELDS are replaced); a very long text is read whole, in time that grows with
its length.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reviewlane.llm.common import worker_cache

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases with label and strength.
NOTICES = {
    "apache license 2": ("apache-2", 0.6),
    "mit license": ("mit", 0.6),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.6),
    "cc by nd": ("cc-by-nd", 0.6),
    "cc0": ("cc0", 0.6),
    "released into the public domain": ("public-domain", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "cc-by-4", "cc-by-3", "0bsd", "python", "boost", "bsl")

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_EXPRESSION = re.compile(r"(?i)spdx-license-identifier:?[ \t]*([A-Za-z0-9.+\-() \t:]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+\-:]+")
_RANK = {"or": 1, "and": 2, "with": 3}
# License identifiers of lower-case letters alone; other such words are prose.
_PLAIN = {"blessing", "checkmk", "curl", "diffmark", "dvipdfm", "gnuplot", "libtiff", "psutils", "snprintf", "xpp"}


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the tokens of an expression in postfix order; raises ValueError if it is broken."""
    out, held, operand = [], [], False
    for token in _expression_tokens(expression):
        low = token.lower()
        if token in ("(", ")"):
            if (token == "(") == operand:
                raise ValueError(f"{token} out of place")
            if token == "(":
                held.append(token)
                continue
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError(") without (")
            held.pop()
        elif low in _RANK:
            if not operand:
                raise ValueError(f"{token} without a left side")
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        else:
            out.append(low)
            operand = True
    if not operand or "(" in held:
        raise ValueError("incomplete expression")
    return out + held[::-1]


def _expression_tokens(text: str) -> list[str]:
    """The tokens up to the first that cannot belong to the expression."""
    found, depth, operand = [], 0, False
    for token in _TOKEN.findall(text):
        depth += (token == "(") - (token == ")")
        operator = token.lower() in _RANK and (token.isupper() or depth > 0 and token.islower())
        if token not in ("(", ")") and not operator:
            named = not token.isalpha() or not token.islower() or token in _PLAIN
            if operand or not named or token.lower() in _RANK:
                while len(found) > 1 and found[-1].lower() in _RANK:
                    found.pop()
                break
        found.append(token)
        operand = token == ")" or token != "(" and not operator
    return found


def evaluate(expression: str) -> tuple[set[str], bool]:
    """(labels, whether permissive licenses alone can meet it)."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix(expression):
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":  # an exception widens what its license allows
                name = "+".join(sorted(left[0])) + " with " + "+".join(sorted(right[0]))
                stack.append((left[0] | {name}, left[1]))
            else:
                met = left[1] or right[1] if token == "or" else left[1] and right[1]
                stack.append((left[0] | right[0], met))
        else:
            stack.append(({token}, token.startswith(PERMISSIVE)))
    return stack.pop()


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score)."""
    raw = (text or "").encode()
    words = [w for w in raw.translate(_WORD_BYTES).split(b" ") if w]
    plain = " " + b" ".join(words).decode("latin-1") + " "  # one character a byte; the phrases are ASCII
    starts, base, labels, score, tagged = [], set(), set(), 0.0, False
    for end, phrase in machine.iter(plain):
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
            score = max(score, 0.9)
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            score = max(score, weight)
        tagged |= phrase == TAG
    places, at = [], 0
    for start in sorted(starts):  # spaces before a phrase, counted on from the one before it
        places.append((places[-1] if places else 0) + plain.count(" ", at, start))
        at = start
    if tagged:
        met = []
        for m in _EXPRESSION.finditer(text):
            try:
                named, permissive = evaluate(m[1])
            except ValueError:
                named, permissive = {t.lower() for t in _expression_tokens(m[1]) if t.lower() not in {*_RANK, "(", ")"}}, True
            if named:
                labels |= {x.replace(",", " ") for x in named}
                met.append(permissive)
        if met:
            score = 1.0 if any(met) else 0.5
    first, last = (min(places), max(places)) if places else (None, None)
    join = lambda x: ",".join(sorted(x))
    return len(words), len(places), first, last, join(base), join(base | labels), score


FIELDS = [
    ("n_words", T.LongType(), pa.int64()),
    ("n_base", T.LongType(), pa.int64()),
    ("first_word", T.LongType(), pa.int64()),
    ("last_word", T.LongType(), pa.int64()),
    ("base_labels", T.StringType(), pa.string()),
    ("labels", T.StringType(), pa.string()),
    ("score", T.DoubleType(), pa.float64()),
]


def scan(documents: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """documents with the FIELDS (columns of those names are replaced)."""
    names = [f[0] for f in FIELDS]
    kept = [c for c in documents.columns if c not in names and (keep_text or c != text)]
    schema = T.StructType([*(documents.schema[c] for c in kept), *(T.StructField(n, t) for n, t, _ in FIELDS)])

    def run(batches):
        machine = worker_cache("licenses", automaton)
        for batch in batches:
            rows = [scan_text(x.as_py(), machine) for x in batch.column(text)]
            found = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, *names])

    return documents.mapInArrow(run, schema)

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from reviewlane.llm import chat, secrets
from reviewlane.llm.common import ALNUM_WORD

_LOW = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    kinds = []
    for order, r in enumerate(secrets.RULES):
        p = _quoted(f"({r.pattern})")
        kinds.append(f"""
        SELECT k, {order} AS ord, '{r.kind}' AS kind,
               regexp_extract_all(t, {p}, 1) AS m, regexp_extract_all(t, {p}, {r.group + 1 if r.group else 1}) AS v,
               regexp_split_to_array(t, {_quoted(r.pattern)}) AS gaps, {r.least} AS least
        FROM d""")
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({' UNION ALL '.join(kinds)}),
    spans AS (
        SELECT k, ord, kind, i,
               list_sum([length(x) FOR x IN list_slice(gaps, 1, i)]) + coalesce(list_sum([length(x) FOR x IN list_slice(m, 1, i - 1)]), 0) AS s,
               length(m[i]) AS n, length(v[i]) AS measure, least
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0)),
    kept AS (SELECT *, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS txt FROM spans WHERE measure >= least),
    agg AS (
        SELECT k, {counts},
               string_agg(txt, ',' ORDER BY s, ord) FILTER (WHERE kind IN ({base})) AS b, string_agg(txt, ',' ORDER BY s, ord) AS a
        FROM kept GROUP BY k)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)},
           sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
    FROM d LEFT JOIN agg USING (k)"""


def _chat() -> str:
    def escaped(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for mark in chat.CONTROL:
            out = f"replace({out}, {_quoted(mark)}, {_quoted(mark[0] + chr(92) + mark[1:])})"
        return out

    return f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length({escaped('text')}) + CASE WHEN before = role THEN {len(chat.NEXT)}
               ELSE {len('<|role:|>') + len(chat.END)} + length({escaped('role')}) END) AS BIGINT) AS formatted_chars
    FROM o GROUP BY conv_id"""


def _decontaminate() -> str:
    words = lambda t: f"regexp_extract_all({_LOW.format(t=t)}, '{ALNUM_WORD}')"
    return f"""
    WITH b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
    bw AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS win
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
    d AS (SELECT row_number() OVER () AS k, doc_id, {words('text')} AS w FROM documents),
    lens AS (SELECT DISTINCT n FROM bw),
    dw AS (
        SELECT k, n, i, list_slice(w, i, i + n - 1) AS win
        FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
    hit AS (SELECT k, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
    cov AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
    it AS (SELECT k, string_agg(s, ',' ORDER BY s) AS ids, count(*) AS n_items
           FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY k)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN cov USING (k) LEFT JOIN it USING (k)"""


_NEGATIVES = """
    WITH r AS (
        SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.uid AS anchor, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id,
               CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
        FROM r a JOIN r b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE alike) WHERE place <= 5),
    n AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def _divergence() -> str:
    low = _LOW.format(t="text")
    share = lambda n, total: f"1 + (1000000000 * (CAST({n} AS HUGEINT) + 5)) // ({total} + 5 * v)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({low}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
    langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
    c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (
        SELECT g.lang, g.source, coalesce(l.v, 0) AS v, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total, l.total AS lang_total
        FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON g.lang = l.lang
        LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source, l.v, l.total),
    p AS (
        SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "g.total")} AS p, {share("kept.n", "g.lang_total")} AS q
        FROM groups g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
    WHERE part = 'pair' OR rank <= 50"""


_EXACT = r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
    r AS (
        SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
               first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
               row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id) = 1 AS kept FROM d)
    SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM r"""


ORACLES = {
    "op1_secrets": _secrets(),
    "op5_chat": _chat(),
    "op6_decontaminate": _decontaminate(),
    "op11_negatives": _NEGATIVES,
    "op12_divergence": _divergence(),
    "op13_exact_dedup": _EXACT,
}

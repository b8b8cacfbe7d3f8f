"""DuckDB SQL of the text queries that SQL can say."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op10_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
i AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, w[p : p + least(len(w), 10) - 1] AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
places AS (
    SELECT doc_id, n, p, w[p : p + n - 1] AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, p, n FROM places JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op2_jaccard"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM w UNION SELECT root, y FROM r JOIN e ON node = x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.least AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS least FROM r GROUP BY node) c ON w.doc_id = c.node
"""


def _secret_sql() -> str:
    """Matches of every kind, their places as sums of lengths, and the distinct owners of each value."""
    from .secrets import COPIED, KINDS

    def plain(kind) -> str:  # no letter case switch: it would fold two letters beyond ASCII
        if kind.name == "opaque":
            return "[A-Za-z0-9_-]+"
        if "(?i)" not in kind.pattern:
            return kind.pattern
        words, rest = kind.pattern.removeprefix("(?i)").split(")", 1)
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words) + ")" + rest

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, list_transform(string_split_regex(text, {quoted(plain(x))}), lambda t: length(t)) AS gaps, "
        f"regexp_extract_all(text, {quoted(plain(x))}, 0) AS whole, regexp_extract_all(text, {quoted(plain(x))}, {x.group}) AS value FROM d"
        for k, x in enumerate(KINDS)
    )
    opaque = next(k for k, x in enumerate(KINDS) if x.name == "opaque")
    long_enough = " ".join(f"WHEN {k} THEN {x.least}" for k, x in enumerate(KINDS))
    base = ", ".join(str(k) for k, x in enumerate(KINDS) if x.base)
    names = "[" + ", ".join(quoted(x.name) for x in KINDS) + "]"
    span = f"{names}[kind + 1] || ':' || start || ':' || stop"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {k}), 0) AS n_{x.name}" for k, x in enumerate(KINDS) if x.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
found AS ({found}),
each AS (
    SELECT rid, kind, i, gaps[i] AS gap, length(whole[i]) AS n, value[i] AS value
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)),
placed AS (SELECT *, sum(gap + n) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM each),
good AS (
    SELECT rid, kind, value, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM placed
    WHERE length(value) >= CASE kind {long_enough} END
        AND (kind <> {opaque} OR (regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')))),
owned AS (SELECT value, count(DISTINCT source) AS owners FROM good JOIN d USING (rid) GROUP BY value),
spans AS (SELECT * FROM good JOIN owned USING (value) WHERE kind IN ({base}) OR owners <= 1),
per AS (
    SELECT rid, {counts}, string_agg({span}, ',' ORDER BY start, kind) FILTER (kind IN ({base})) AS base, string_agg({span}, ',' ORDER BY start, kind) AS spans,
        count(*) FILTER (owners <= 1) AS n_live, count(*) FILTER (owners >= {COPIED}) AS n_copied FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{x.name}, 0)::BIGINT AS n_{x.name}" for x in KINDS if x.base)}, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN per USING (rid)
"""


ORACLES["op4_secrets"] = _secret_sql()


def _license_sql() -> str:
    """Every line against every template, and every phrase at every word."""
    from .licenses import PHRASES, TEMPLATES

    templates = ", ".join(f"('{label}', {number}, '{text}')" for number, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in PHRASES)
    words = lambda t: (
        f"list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    )
    return f"""
WITH t AS (SELECT label, number, list_distinct(string_split(words, ' ')) AS w FROM (VALUES {templates}) v(label, number, words)),
p AS (SELECT * FROM (VALUES {phrases}) v(label, w)),
d AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM documents),
places AS (
    SELECT doc_id, label, i - 1 AS spot FROM (SELECT doc_id, d.w AS dw, p.w AS pw, label, unnest(range(1, len(d.w) + 1)) AS i FROM d, p WHERE len(list_intersect(d.w, p.w)) = len(p.w))
    WHERE dw[i : i + len(pw) - 1] = pw),
base AS (
    SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS labels
    FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, list_distinct({words("line")}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
held AS (
    SELECT doc_id, label, len(list_intersect(lines.w, t.w)) / len(t.w) AS share FROM lines, t
    WHERE 1000 * len(list_intersect(lines.w, t.w)) >= 800 * len(t.w)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM held GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(base.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLES["op6_licenses"] = _license_sql()

# Base32 of a SHA-1: four times five bytes as a number, cut into eight groups of five bits.
ORACLES["op11_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS place,
        first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS head FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(sha, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN place > 1 THEN head END AS refers_to, true AS intact
FROM k
"""

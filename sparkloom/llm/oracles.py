"""The operators' results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import pii

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS b, item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS key
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS key
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hit AS (
  SELECT dw.r, dw.p, dw.size, bw.item_id, bw.p - dw.p AS diagonal FROM dw JOIN bw USING (key, size)
), words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r
), islands AS (
  SELECT r, item_id, diagonal, min(p) AS a, max(p + size) AS z
  FROM (SELECT *, p - row_number() OVER (PARTITION BY r, item_id, diagonal ORDER BY p) AS island FROM (SELECT DISTINCT r, item_id, diagonal, p, size FROM hit)) GROUP BY r, item_id, diagonal, island
), joined AS (
  SELECT r, item_id, diagonal, min(a) AS a, max(z) AS z FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY r, item_id, diagonal ORDER BY a) AS g FROM (
      SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY r, item_id, diagonal ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM islands))
  GROUP BY r, item_id, diagonal, g
), longest AS (
  SELECT r, max(z - a) AS longest FROM joined GROUP BY r
), alike AS (
  SELECT r, b, i - j AS diagonal, i - row_number() OVER (PARTITION BY r, b, i - j ORDER BY i) AS run
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN (SELECT b, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM b) USING (word)
), verbatim AS (
  SELECT r, max(n) AS verbatim FROM (SELECT r, count(*) AS n FROM alike GROUP BY r, b, diagonal, run) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match, CAST(coalesce(verbatim, 0) AS BIGINT) AS longest_verbatim
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r) LEFT JOIN verbatim USING (r)
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT body AS same, min(page_id) AS first_id, count(*) AS n FROM p GROUP BY body
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN n > 1 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, true AS intact
FROM p JOIN f ON body = same
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [concat(len(w), '  ', array_to_string(w, ' '))] ELSE [] END) AS shingle FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, b AS other FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_other, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least_other FROM reach GROUP BY doc_id) USING (doc_id)
"""

# the contract's plain patterns; the others are the operator's own
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255))",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND CAST(list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[length({_DIGITS}) - i + 1] AS INTEGER) WHEN CAST({_DIGITS}[length({_DIGITS}) - i + 1] AS INTEGER) > 4 THEN 2 * CAST({_DIGITS}[length({_DIGITS}) - i + 1] AS INTEGER) - 9 ELSE 2 * CAST({_DIGITS}[length({_DIGITS}) - i + 1] AS INTEGER) END)) AS BIGINT) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[1:4], ''), lambda c: CAST(CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END AS BIGINT))), lambda a, x: (a * CASE WHEN x >= 10 THEN 100 ELSE 10 END + x) % 97) = 1",
    "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
}


def _pii() -> str:
    """One block for each kind: matches, the texts around them, places, then what confirms them."""
    parts = []
    for rank, kind in enumerate(pii.KINDS):
        pattern = _PLAIN.get(kind.name, kind.pattern).replace("(?:", "(")
        near = f"lower(right(gap, {pii.CONTEXT}))"
        words = lambda w: f"regexp_matches({near}, '(^|[^a-z])({'|'.join(w)})')"  # noqa: B023,E731
        score = f"CAST({kind.score} AS DOUBLE)"
        score += f" + CASE WHEN {words(kind.raising)} THEN CAST({pii.RAISE} AS DOUBLE) ELSE 0 END" if kind.raising else ""
        score += f" - CASE WHEN {words(kind.lowering)} THEN CAST({pii.LOWER} AS DOUBLE) ELSE 0 END" if kind.lowering else ""
        border = "true"
        if kind.border:
            border = f"CASE WHEN gap = '' THEN i = 1 ELSE NOT regexp_matches(right(gap, 1), '{kind.border}') END AND CASE WHEN rest = '' THEN i = n ELSE NOT regexp_matches(left(rest, 1), '{kind.border}') END"
        length = lambda x: f"CAST(coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0) AS BIGINT)"
        parts.append(f"""
  SELECT r, {rank} AS rank, '{kind.name}' AS kind, a AS a, a + length(m) AS z, round(greatest(0.0, least(1.0, {score})), 2) AS score
  FROM (SELECT r, i, len(h) AS n, h[i] AS m, g[i] AS gap, g[i + 1] AS rest, {length('g[1:i]')} + {length('h[1:i - 1]')} AS a
        FROM (SELECT r, h, g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS g FROM d)))
  WHERE {_VALID[kind.name]} AND round(greatest(0.0, least(1.0, {score})), 2) >= {kind.least} AND {border}""")
    counts = lambda kinds: ", ".join(f"CAST(count(*) FILTER (kind = '{k.name}') AS BIGINT) AS n_{k.name}" for k in kinds)
    text = "kind || ':' || a || ':' || z"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts(pii.BASE)}, sha256(coalesce(string_agg({text}, ',' ORDER BY a, rank) FILTER (rank < {len(pii.BASE)}), '')) AS base_sha256,
       coalesce(string_agg({text}, ',' ORDER BY a, rank), '') AS spans, {counts(pii.MORE)}, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY a, rank), '') AS scores
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
"""


PII = _pii()

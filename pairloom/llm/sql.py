"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
         ELSE '=' || replace(role, '\', '\b') END AS name,
    replace(replace(text, '\', '\b'), '</turn>', '\l/turn>') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM spoken
), marked AS (
  -- '#' prior '##' is escaped by one character more, which the count of such places adds
  SELECT *, length(body) + (SELECT count(*) FROM range(1, length(body) - 1) AS r(i) WHERE substr(body, r.i, 3) = '###') AS chars,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prior
  FROM escaped
), judged AS (
  SELECT *, NOT ((prior = '' AND pos = 0 AND role IN ('system', 'user')) OR (prior = 'system' AND role = 'user')
    OR (prior = 'user' AND role = 'assistant') OR (prior = 'assistant' AND role = 'user')) AS refused
  FROM marked
), summed AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS under,
    CAST(sum(4 + length(name) + 2 + chars + 8) AS BIGINT) AS formatted_chars,
    coalesce(min(pos) FILTER (WHERE refused), CASE WHEN arg_max(role, pos) <> 'assistant' THEN count(*) END) AS bad_turn
  FROM judged GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(under) AS loss_chars, sha256(under) AS loss_sha256, formatted_chars,
  bad_turn IS NULL AS valid, CAST(bad_turn AS BIGINT) AS bad_turn
FROM summed
"""

# every run of two or more lines that an earlier place holds, as pairs of neighbouring lines
LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), pairs AS (
  SELECT doc_id, pos, line AS one, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS two FROM lines
  QUALIFY two IS NOT NULL AND regexp_matches(one || two, '[^ \t-\r]')
), placed AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS first_id, first_value(pos) OVER w AS first_pos,
    row_number() OVER w AS nth FROM pairs WINDOW w AS (PARTITION BY one, two ORDER BY doc_id, pos)
), gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM placed WHERE nth > 1 AND NOT (doc_id = first_id AND pos - first_pos < 2)
), left_over AS (
  SELECT n.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
    coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_removed, 0) AS n_removed,
  length(l.text) AS n_chars, sha256(l.text) AS text_sha256
FROM documents d LEFT JOIN left_over l ON d.doc_id = l.doc_id
"""

_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"
_ALNUM = _WORDS.replace("{word}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLANK = _WORDS.replace("{word}", r"[^\x20\x09-\x0D]+")

DECONTAMINATION = f"""
WITH doc_words AS (SELECT doc_id, {_ALNUM.format(text="text")} AS w FROM documents),
item_words AS (SELECT item_id, {_ALNUM.format(text="text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, CAST(least(len(w), 10) AS BIGINT) AS size,
    array_to_string(w[r.i : r.i + least(len(w), 10) - 1], ' ') AS words
  FROM item_words, range(1, greatest(len(w) - 8, 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT d.doc_id, r.i AS pos, s.size, array_to_string(d.w[r.i : r.i + s.size - 1], ' ') AS words
  FROM doc_words d, sizes s, range(1, CAST(len(d.w) - s.size + 2 AS BIGINT)) AS r(i) WHERE len(d.w) >= s.size
), hits AS (SELECT f.doc_id, f.pos, f.size, w.item_id FROM found f JOIN windows w ON f.words = w.words AND f.size = w.size),
positions AS (
  SELECT doc_id, count(DISTINCT pos + r.i) AS n_hit FROM hits, range(0, size) AS r(i) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit,
  coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN positions p ON d.doc_id = p.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

NEAR = f"""
WITH RECURSIVE doc_words AS (SELECT doc_id, {_BLANK.format(text="text")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[r.i : r.i + 2], ' ') AS shingle
  FROM doc_words, range(1, greatest(len(w) - 1, 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), least_reached AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, coalesce(d.doc_id = l.component_id, true) AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least_reached l ON d.doc_id = l.doc_id
"""

_TRUST_START = r"""
WITH judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM (SELECT page_id, html,
      translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
), hosts AS MATERIALIZED (
  SELECT host, count(*) FILTER (WHERE rule IN ('org/', 'com/fr/')) AS good,
    count(*) FILTER (WHERE rule IS NOT NULL AND rule NOT IN ('org/', 'com/fr/')) AS bad
  FROM judged WHERE host <> '' GROUP BY host
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html,
      'href\s*=\s*["'']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM judged WHERE host <> ''
), names AS (SELECT host, string_split(host, '.') AS n FROM hosts),
family AS (
  SELECT DISTINCT array_to_string(n[r.i : ], '.') AS host, array_to_string(n[r.i + 1 : ], '.') AS parent
  FROM names, range(1, CAST(len(n) - 1 AS BIGINT)) AS r(i)
), edges AS MATERIALIZED (
  SELECT src, dst, sum(n) AS n FROM (
    SELECT src, dst, 1 AS n FROM links WHERE src <> dst
    UNION ALL SELECT host, parent, 1 FROM family UNION ALL SELECT parent, host, 1 FROM family) GROUP BY src, dst
), ways AS (
  SELECT 'good' AS kind, src AS host, dst AS target, n FROM edges UNION ALL SELECT 'bad', dst, src, n FROM edges
), shares AS MATERIALIZED (SELECT *, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM ways),
seeds AS MATERIALIZED (
  SELECT 'good' AS kind, host, good / (SELECT sum(good) FROM hosts) AS seed FROM hosts WHERE good > 0
  UNION ALL SELECT 'bad', host, bad / (SELECT sum(bad) FROM hosts) FROM hosts WHERE bad > 0
), rank0 AS (SELECT kind, host, seed AS r FROM seeds)"""


def trust(steps: int, damping: float, threshold: float) -> str:
    """The rank iteration, written out step by step."""
    parts = [_TRUST_START]
    for i in range(steps):
        parts.append(f"""rank{i + 1} AS MATERIALIZED (
  SELECT kind, host, sum(r) AS r FROM (
    SELECT s.kind, s.target AS host, r.r * s.share * {damping} AS r
    FROM rank{i} r JOIN shares s ON r.kind = s.kind AND r.host = s.host
    UNION ALL SELECT kind, host, seed * (1 - {damping}) FROM seeds) GROUP BY kind, host
)""")
    parts.append(f"""ranks AS (
  SELECT host, coalesce(sum(r) FILTER (WHERE kind = 'good'), 0) AS trust,
    coalesce(sum(r) FILTER (WHERE kind = 'bad'), 0) AS distrust FROM rank{steps} GROUP BY host
)
SELECT j.page_id, j.host, j.path, j.rule, CASE
  WHEN j.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN j.rule IS NOT NULL THEN 'block'
  WHEN r.distrust > ({threshold} + 1e-9) * (r.trust + r.distrust) THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN ranks r ON j.host = r.host""")
    return ",\n".join(parts)

# crc32 by its bits: the polynomial of zlib, one byte of the decimal id after the other
TRIE = r"""
WITH spoken AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT conv_id AS c FROM spoken), taken AS (
  SELECT c, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
  )) % 9 AS h FROM ids
), placed AS (
  SELECT c, 0 AS part, pos, role, text FROM taken JOIN spoken ON conv_id = c - c % 5 AND pos <= h
  UNION ALL SELECT c, 1, pos, role, text FROM taken JOIN spoken ON conv_id = c AND pos > h
), numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM placed),
keyed AS (
  SELECT c, d, strlen(text) AS bytes, md5(string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS key
  FROM numbered
), members AS (SELECT c, 0 AS d, 0 AS bytes, 'root' AS key FROM ids UNION ALL SELECT * FROM keyed),
linked AS (
  SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS above, d = max(d) OVER (PARTITION BY c) AS ends FROM members
), nodes AS (
  SELECT key, any_value(above) AS above, any_value(d) AS d, min(c) AS least, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM linked GROUP BY key
), kids AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (
  SELECT m.key, sum((w.n - 1) * w.bytes) AS saved, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves
  FROM nodes w JOIN members m ON m.c = w.least AND m.d <= w.d LEFT JOIN kids k ON k.key = w.key GROUP BY m.key
)
SELECT v.least AS conv_id, v.d AS depth, p.least AS parent_conv_id, v.n AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes p ON p.key = v.above LEFT JOIN kids k ON k.key = v.key JOIN below b ON b.key = v.key
"""


def clusters(k: int = 40, n_rounds: int = 5, seed: int = 2) -> str:
    """Plain rounds: every distance in every round."""
    steps = [
        f"""
vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS j, v AS c FROM vecs
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k}
)"""
    ]
    for t in range(n_rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, vec_id, v, j, d FROM (
    SELECT r, vec_id, v, j, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM vecs, c{t}
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1
)""")
        if t < n_rounds:
            steps.append(f"""
m{t} AS (
  SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
  FROM (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY j, i) GROUP BY j
), c{t + 1} AS MATERIALIZED (SELECT c{t}.j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON m{t}.j = c{t}.j)""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{n_rounds} a JOIN c{n_rounds} c ON c.j = a.j
"""

REPEATS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), cuts AS (  -- short pieces, since substr reads a string from its start
  SELECT r, doc_id, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT), 200)) AS low, h FROM docs WHERE length(h) >= 100
), pieces AS (SELECT r, doc_id, low, substr(h, CAST(2 * low + 1 AS BIGINT), 498) AS h FROM cuts),
starts AS (SELECT r, doc_id, low, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS p, h FROM pieces),
strings AS (
  SELECT r, doc_id, low + p AS p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM starts
), least AS (SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING count(*) > 1),
hit AS (
  SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50, true) AS fresh FROM strings JOIN least USING (s) WHERE least < doc_id
), spans AS (
  SELECT r, span, min(p) AS low, max(p) + 50 AS high
  FROM (SELECT r, p, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY p) AS span FROM hit) GROUP BY r, span
), gaps AS (
  SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS low, low AS high FROM spans
  UNION ALL SELECT r, max(high), 1000000000 FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(h, CAST(2 * low + 1 AS BIGINT), CAST(2 * (gaps.high - low) AS BIGINT)), '' ORDER BY low) AS h FROM gaps JOIN docs USING (r) GROUP BY r
), counted AS (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (r) LEFT JOIN counted c USING (r)
"""

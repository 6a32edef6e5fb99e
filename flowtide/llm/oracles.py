"""DuckDB SQL for the rows of the training-data queries that SQL can express.

Not expressed: token ids and counts of the tokenizers' files, fingerprints, trained models, and the raked mixture; their
tests compare with the libraries, exact sets, held-out labels and the targets.
"""
from __future__ import annotations

from flowtide.llm.secrets import BASE, FURTHER

ORACLES: dict[str, str] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The patterns in the form of the other engine, whose (?i) also folds letters beyond ASCII.
_KINDS = [
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
               "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
_KINDS += [(r.kind, r.pattern, r.group, r.least) for r in FURTHER]
assert [k[0] for k in _KINDS] == [r.kind for r in BASE + FURTHER]


def _found(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    return f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rk, i, length(gaps[i]) AS gap, length(hits[i]) AS size, length(parts[i]) >= {least} AS counts
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
  SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
    regexp_extract_all(t, '{pattern}', {group}) AS parts FROM d WHERE regexp_matches(t, '{pattern}')))"""


def _joined(where: str) -> str:
    return (f"coalesce(string_agg(kind || ':' || CAST(stop - size AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' "
            f"ORDER BY stop - size, rk) FILTER ({where}), '')")


ORACLES["op1_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(*k, rank) for rank, k in enumerate(_KINDS))}),
s AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM f)
SELECT d.doc_id, sha256(any_value(d.t)) AS blob, count(*) FILTER (kind = 'assign') AS n_assign,
  count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({_joined("kind IN ('assign', 'access', 'hex')")}) AS base_sha256, {_joined("kind IS NOT NULL")} AS spans
FROM d LEFT JOIN (SELECT * FROM s WHERE counts) s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

_CRC = [0]
for _n in range(1, 16):         # the checksum's table for four bits at a time, by its rule
    _c = _n
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC.append(_c)

#: Hexadecimal digits, the low one of each byte first, are folded into the checksum.
_CRC32 = f"""xor(list_reduce(list_transform(string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), ''),
    lambda h: CAST(strpos('0123456789ABCDEF', h) - 1 AS BIGINT)),
  lambda a, x: xor((({_CRC})::BIGINT[])[(xor(a, x) & 15) + 1], a >> 4), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLES["op4_byte_shards"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, CASE WHEN t = '' THEN 0 ELSE {_CRC32} END AS text_crc32 FROM d),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32) - size AS before, sum(size) OVER () AS total,
  row_number() OVER (ORDER BY doc_id, size, text_crc32) AS rn FROM s),
c AS (SELECT *, CAST(least(15, (2 * before + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(rn - min(rn) OVER (PARTITION BY shard) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM c
"""

ORACLES["op9_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM
  (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id, d.doc_id = m.b AS kept
FROM documents d JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op10_decontamination"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM
  (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
h AS (SELECT doc_id, p, v.k, item_id FROM v JOIN i ON i.k = v.k AND i.g = v.g),
a AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

ORACLES["op11_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (SELECT r, lang, source, t, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
k AS (SELECT lang, t, CAST(sum(n) AS HUGEINT) AS whole FROM c GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(whole) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT c.lang, source, c.t, CAST(sum(n) AS HUGEINT) AS n FROM c JOIN k ON k.lang = c.lang AND k.t = c.t GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.t, coalesce(n.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (k.whole + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = k.t),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', t, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

_SPLIT = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES["op12_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
h AS (SELECT r, i FROM g JOIN (SELECT g FROM g GROUP BY g HAVING count(*) > 1) USING (g)),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM h),
l AS (SELECT r, list(p) AS gone FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(coalesce(gone, [])) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l ON l.r = d.r
"""

ORACLES["op13_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || h[k:k + 7] AS BIGINT)) AS k FROM d),
c AS (SELECT *, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS a, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 100 THEN 'plain'
      WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""

from flowtide.llm import licenses as _L  # noqa: E402

_TEXTS = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(_L.TEMPLATES))
_COMMON = ", ".join(f"'{w}'" for w in sorted(_L.COMMON))
_MARKED = " + ".join(f"CAST(regexp_matches(s, '(?i){m}') AS INTEGER)" for m in _L.MARKS)

ORACLES["op6_license_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS dir, coalesce(text, '') AS t,
    coalesce(CAST(doc_id AS VARCHAR), sha256(coalesce(text, ''))) || '.txt' AS name FROM documents),
x(m, license, body) AS (VALUES {_TEXTS}),
c AS (SELECT m, license, w, count(*) AS n FROM (SELECT m, license, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS w FROM x) GROUP BY ALL),
i AS (SELECT w, ln((1 + (SELECT count(*) FROM x)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY w),
v AS (SELECT m, license, c.w, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY m)) AS weight,
    CAST(c.w NOT IN ({_COMMON}) AND NOT regexp_matches(c.w, '^[0-9]$') AS INTEGER) AS tells FROM c JOIN i ON i.w = c.w),
u AS (SELECT r, kind, row_number() OVER () AS k, s FROM (
  SELECT r, 0 AS kind, t AS s FROM d UNION ALL SELECT r, 1, unnest(string_split_regex(t, '\\r?\\n[^A-Za-z0-9\\n]*\\n')) FROM d
  UNION ALL SELECT r, 2, unnest(string_split_regex(regexp_replace(t, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), '[\\r\\n]+')) FROM d)
  WHERE {_MARKED} >= CASE WHEN kind < 2 THEN {_L.LONG_MARKS} ELSE 1 END),
b AS (SELECT r, kind, k, w, count(*) AS n FROM (SELECT r, kind, k, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM u) GROUP BY ALL),
f AS (SELECT b.*, n * coalesce(idf, ln(1 + (SELECT count(*) FROM x)) + 1) AS value FROM b LEFT JOIN i ON i.w = b.w),
l AS (SELECT k, sqrt(sum(value * value)) AS norm FROM f GROUP BY k),
s AS (SELECT f.r, f.kind, v.license, round(sum(f.value * v.weight) / any_value(l.norm), 6) AS cosine FROM f JOIN v ON v.w = f.w JOIN l ON l.k = f.k
  GROUP BY f.r, f.kind, f.k, v.m, v.license HAVING sum(v.tells) > 1 AND round(sum(f.value * v.weight) / any_value(l.norm), 6) >= {_L.LEAST}),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY cosine DESC, license, kind) AS rn FROM s) WHERE rn = 1),
g AS (SELECT dir, license FROM (SELECT d.dir, o.license, row_number() OVER (PARTITION BY d.dir ORDER BY o.cosine DESC, d.name, o.license) AS rn
  FROM o JOIN d ON d.r = o.r WHERE o.kind = 0) WHERE rn = 1)
SELECT doc_id, d.dir || '/' || name AS path, o.license AS own_license, cosine, (['whole', 'paragraph', 'sentence'])[o.kind + 1] AS license_unit,
  coalesce(o.license, g.license) AS license, CASE WHEN o.license IS NULL THEN g.dir END AS inherited_from
FROM d LEFT JOIN o ON o.r = d.r LEFT JOIN g ON g.dir = d.dir
"""

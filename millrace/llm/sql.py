"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import sharding

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM words WHERE side = 'i' AND len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT id AS doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE side = 'd' AND len(w) >= n)
), found AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM (SELECT * FROM words WHERE side = 'd') d LEFT JOIN hit ON hit.doc_id = d.id LEFT JOIN items ON items.doc_id = d.id
"""

_BASE32 = " || ".join(
    f"translate(lpad(lower(to_base(CAST('0x' || substr(hex, {1 + 10 * i}, 10) AS BIGINT), 32)), 8, '0'), '0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for i in range(4)
)
OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN m USING (hex)
"""

OP6 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(min(r.other), t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN reach r ON r.doc_id = t.doc_id GROUP BY t.doc_id, n.n
"""


def _draw(name: str, weight: float) -> str:
    return f"(-ln((CAST(('0x' || substr(md5('{name}/' || k), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / {float(2**52)!r}::DOUBLE) / {weight!r}::DOUBLE)"


def _least(options: list[tuple[str, str]]) -> str:
    """The value whose draw is least, among (draw, value)."""
    return options[0][1] if len(options) == 1 else "list_min([" + ", ".join(f"{{'d': {d}, 'v': {v}}}" for d, v in options) + "]).v"


def _shard_sql(shards: list[sharding.Shard]) -> str:
    regions: dict[str, dict[str, list[sharding.Shard]]] = {}
    for s in shards:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def case(pick: str, branches: list[str]) -> str:
        return branches[0] if len(branches) == 1 else f"CASE {pick} " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches)) + " END"

    def rack(r: str, k: str, own: list[sharding.Shard]) -> str:
        return _least([(_draw(f"{r}.{k}.{s.number}", s.weight), str(s.number)) for s in own])

    def region(r: str, racks: dict[str, list[sharding.Shard]]) -> str:
        pick = _least([(_draw(f"{r}.{k}", sum(s.weight for s in own)), str(i)) for i, (k, own) in enumerate(racks.items())])
        return case(pick, [rack(r, k, own) for k, own in racks.items()])

    pick = _least([(_draw(r, sum(s.weight for own in racks.values() for s in own)), str(i)) for i, (r, racks) in enumerate(regions.items())])
    return case(pick, [region(r, racks) for r, racks in regions.items()])


_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
#: CRC-32 by a table of 256 entries, which the polynomial gives.
_CRC = f"""
crc_steps(i, step, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS r(i) UNION ALL SELECT i, step + 1, {_CRC_STEP} FROM crc_steps WHERE step < 8
), crc_table AS (SELECT list(c ORDER BY i) AS entries FROM crc_steps WHERE step = 8)
"""
OP7 = f"""
WITH RECURSIVE {_CRC}, k AS (SELECT doc_id, coalesce(text, '') AS body, text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
g AS (SELECT *, CAST('0x' || substr(md5(k), 14, 8) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / {16.0 * sharding.SLOT_GROUP_ROWS}) AS BIGINT)) AS grp FROM k),
p AS (
  SELECT doc_id, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(hex(encode(body)), 2 * i + 1, 2) AS BIGINT) for i in range(octet_length(encode(body)))]),
      lambda c, b: xor(c // 256, entries[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS text_crc32,
    'key' AS law, CAST({_shard_sql(sharding.fleet(16, 16))} AS INTEGER) AS shard, CAST({_shard_sql(sharding.fleet(17, 16))} AS INTEGER) AS grown_shard, grp
  FROM g, crc_table
)
SELECT doc_id, size, text_crc32, law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY grp, doc_id) - 1 AS BIGINT) AS slot, grown_shard FROM p
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) for x in e]) AND list_bool_or([x <> 0 for x in e])),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(min(r.b), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(min(r.b), v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""

OP12 = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w,
    row_number() OVER () AS k
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, k, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
wide AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v.v
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM wide),
whole AS (SELECT lang, term, sum(n) AS n, v FROM wide GROUP BY lang, term, v),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM whole),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 10
"""

OP13 = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT k, o, len(h) // 2 - 399 - o AS n, substr(h, 2 * o + 1, 2 * 2447) AS h FROM (SELECT k, h, unnest(range(0, len(h) // 2 - 399, 2048)) AS o FROM d)),
w AS (SELECT k, o + x AS x, md5(substr(h, 2 * x + 1, 800)) AS m FROM (SELECT k, o, h, unnest(range(0, least(n, 2048))) AS x FROM parts)),
r AS (SELECT k, x FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
s AS (SELECT k, x, sum(CASE WHEN before IS NULL OR x > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY x) AS run FROM (SELECT k, x, lag(x) OVER (PARTITION BY k ORDER BY x) AS before FROM r)),
runs AS (SELECT k, min(x) AS a, max(x) + 400 AS b FROM s GROUP BY k, run),
cuts AS (SELECT k, count(*) AS n, sum(b - a) AS removed, list(b ORDER BY a) AS b, list(a ORDER BY a) AS a FROM runs GROUP BY k)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string([substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1])) FOR z IN list_zip(list_prepend(0, b), list_append(a, len(h) // 2))], '') END)) AS kept_sha256
FROM d LEFT JOIN cuts USING (k)
"""

ORACLES = {"op2_decontamination": OP2, "op3_warc": OP3, "op6_jaccard": OP6, "op7_shards": OP7, "op8_embeddings": OP8, "op12_divergence": OP12, "op13_suffix_dedup": OP13}

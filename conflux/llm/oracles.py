"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import merkle, mixing, negatives, urls

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mixing_sql(documents: str = "documents") -> str:
    """Systematic sampling as the contract has it, in 128-bit numbers: expected copies (rate in units of 2^-30) are
    summed along a source from its offset on, and a document is taken once for each whole number passed."""
    return rf"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM {documents}),
per AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighted AS (SELECT *, (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {mixing.WEIGHTS})::BIGINT AS weight FROM per),
ranked AS (
  SELECT *, row_number() OVER o AS rn, sum(source_size) OVER () AS all_words,
    coalesce(sum(source_size * {mixing.CAP}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighted WINDOW o AS (ORDER BY source_size * 6 // weight, source IS NULL, source)),
level AS (
  SELECT rn AS k, full_words AS fw, open_weight AS ow FROM ranked
  WHERE (all_words - full_words) * weight <= source_size * {mixing.CAP} * open_weight ORDER BY rn LIMIT 1),
aimed AS (
  SELECT source, n_docs, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN k IS NULL OR rn < k THEN (source_size * {mixing.CAP})::DOUBLE
    ELSE weight * (all_words - fw)::DOUBLE / ow::DOUBLE END AS target
  FROM ranked LEFT JOIN level ON true),
rated AS (
  SELECT source, source_size, target, ceil(n_docs / {mixing.CELL})::BIGINT AS cells,
    CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size * {mixing.UNIT})::BIGINT, {mixing.CAP * mixing.UNIT}) END::HUGEINT AS rate,
    (('0x' || substr(md5('{mixing.SEED}' || coalesce('s' || source, 'n')), 1, 15))::BIGINT % {mixing.UNIT})::HUGEINT AS start
  FROM aimed),
dealt AS (
  SELECT d.*, source_size, target, rate, start, (((coalesce(doc_id, 0) % {1 << 31}) * 2654435761) % 4294967291) % cells AS cell
  FROM d JOIN rated ON d.source IS NOT DISTINCT FROM rated.source),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell, size, doc_id NULLS FIRST) AS place FROM dealt),
counted AS (SELECT *, (start + place * rate) // {mixing.UNIT} - (start + (place - 1) * rate) // {mixing.UNIT} AS copies FROM placed)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM counted
"""


def urls_sql() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    return rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{urls.PARTS}', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
    coalesce(regexp_extract(url, '{urls.PARTS}', 2), '') AS path FROM pages),
coded AS (SELECT *, list_transform(string_split('^' || host || '$' || path, ''), lambda c: unicode(c)::BIGINT) AS codes FROM parts),
scored AS (
  SELECT *, CASE WHEN host = '' THEN 0 ELSE coalesce(list_sum(list_transform(range(1, len(codes) - 1),
    lambda i: ({urls.weights()})[((codes[i] * {urls.FACTOR} + codes[i + 1]) * {urls.FACTOR} + codes[i + 2]) % {urls.BUCKETS} + 1]))::BIGINT, 0) END::BIGINT AS score FROM coded)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, score FROM scored
"""


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: '{_BASE32}'[((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in merkle.COLUMNS) + ")"

#: CRC-32 of decimal ids by the polynomial, bit by bit; the trees by level, in recursion; then each row's way up.
MERKLE_SQL = f"""
WITH RECURSIVE
table_of AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda r, _: xor(r >> 1, (r & 1) * 3988292384))) AS crc),
d AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(n_chars::HUGEINT + 1)")} AS changed,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::UBIGINT)),
      lambda r, b: xor(r >> 8, crc[(xor(r, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS crc
  FROM documents, table_of),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    CASE WHEN crc % 7 = 0 THEN coalesce(changed, leaf) ELSE leaf END AS told FROM d),
low AS (
  SELECT lang, 0 AS level, idx, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (min(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, level, idx // 2),
subroots AS (SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place AS idx, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (min(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, idx // 2),
siblings AS (
  SELECT l.doc_id, l.lang, l.idx, s.level, s.idx < (l.idx >> s.level::BIGINT) AS is_left, s.node
  FROM leaves l JOIN low s ON s.lang IS NOT DISTINCT FROM l.lang AND s.idx = xor(l.idx >> s.level::BIGINT, 1)
  UNION ALL
  SELECT l.doc_id, l.lang, l.idx, r.height + s.level, s.idx < (r.place >> s.level::BIGINT), s.node
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN high s ON s.idx = xor(r.place >> s.level::BIGINT, 1)),
proofs AS (SELECT lang, idx, list({{'is_left': is_left, 'node': node}} ORDER BY level) AS way FROM siblings GROUP BY lang, idx),
folds AS (
  SELECT l.lang, l.idx, l.told AS own, coalesce(way, []) AS way, 1 AS k FROM leaves l LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx
  UNION ALL
  SELECT lang, idx, sha256(CASE WHEN way[k].is_left THEN way[k].node || own ELSE own || way[k].node END), way, k + 1 FROM folds WHERE k <= len(way))
SELECT l.doc_id, l.leaf, r.subroot, h.node AS root, sha256(coalesce(array_to_string(list_transform(f.way, lambda x: x.node), ''), '')) AS proof_sha256,
  f.own AS folded_root, f.own = h.node AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN high h ON h.n = 1
JOIN folds f ON f.lang IS NOT DISTINCT FROM l.lang AND f.idx = l.idx AND f.k = len(f.way) + 1
"""

_FINITE = "list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)"

NEGATIVES_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {negatives.NEGATIVES}
"""

ORACLES: dict[str, str] = {"op3_warc": WARC_SQL, "op4_urls": urls_sql(), "op10_mixing": mixing_sql(), "op11_negatives": NEGATIVES_SQL, "op12_merkle": MERKLE_SQL}

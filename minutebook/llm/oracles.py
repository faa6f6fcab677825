"""SQL that pairwise operators must equal, for DuckDB over the given tables.

Brute force in a few statements: every pair or every phrase is looked at,
which is what the operators avoid.
"""

from __future__ import annotations

_WORDS = """words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
)"""

REPEATS = f"""
WITH {_WORDS}, phrases AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS phrase
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM words WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS k FROM phrases) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), placed AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE {_WORDS}, runs AS (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS run
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)
), counted AS (
  SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL
), totals AS (
  SELECT doc_id, sum(c) AS t FROM counted GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS s FROM counted a JOIN counted b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN totals x ON x.doc_id = a JOIN totals y ON y.doc_id = b WHERE 9 * s >= 4 * (x.t + y.t)
), reached AS (
  SELECT doc_id AS node, doc_id AS least FROM documents
  UNION SELECT b, least FROM reached JOIN links ON a = node
)
SELECT node AS doc_id, min(least) AS class_id, node = min(least) AS kept FROM reached GROUP BY node"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / sqrt(a.n * b.n) >= 0.98
), reached AS (
  SELECT vec_id AS node, vec_id AS least FROM embeddings
  UNION SELECT b, least FROM reached JOIN links ON a = node
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT node AS vec_id, coalesce(any_value(n), 0) AS n_links, min(least) AS component_id, node = min(least) AS kept
FROM reached LEFT JOIN degree ON a = node GROUP BY node"""

TOP_PRODUCTS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

MIXTURE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, length(coalesce(text, ''))::BIGINT AS n, ('0x' || substr(md5(concat_ws('|', doc_id, text)), 1, 15))::BIGINT AS key
  FROM documents
), sizes AS (
  SELECT source, sum(n)::BIGINT AS size, ceil(count(*) / 2000.0)::BIGINT AS chunks FROM d GROUP BY source
), shares AS (
  SELECT source, chunks, greatest(1, round(sqrt(size) / sum(sqrt(size)) OVER () * 1000))::BIGINT AS share FROM sizes
), listed AS (
  SELECT list(source ORDER BY source NULLS FIRST) AS sources, list(share ORDER BY source NULLS FIRST) AS w, sum(share)::BIGINT AS slots FROM shares
), turns AS (
  SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, w, slots FROM listed
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: x + (i = p)::BIGINT), p, w, slots FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: done[i] * slots // w[i] <= t),
                                      lambda i: ceil((done[i] + 1) * slots / w[i])::BIGINT * 1000000 + i)) % 1000000 AS p
    FROM turns WHERE t < slots)
), period AS (
  SELECT sources[pick] AS source, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth, turns.slots
  FROM turns, listed WHERE t > 0
), placed AS (
  SELECT doc_id, d.source, share, coalesce(sum(n) OVER (PARTITION BY d.source ORDER BY key % chunks, key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN shares ON d.source IS NOT DISTINCT FROM shares.source
), blocks AS (
  SELECT *, start // 65536 AS block FROM placed
)
SELECT doc_id, b.source, block, block // share * slots + nth * slots // share AS release,
  block // share * slots + ceil((nth + 1) * slots / share)::BIGINT AS deadline, block // share * slots + slot AS slot, start, share
FROM blocks b JOIN period p ON b.source IS NOT DISTINCT FROM p.source AND block % share = nth"""

SEARCH = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), totals AS (
  SELECT count(*)::BIGINT AS texts, sum(len(ts))::BIGINT AS length FROM d WHERE len(ts) > 0
), held AS (
  SELECT row, doc_id, term, count(*)::BIGINT AS tf, n
  FROM (SELECT row, doc_id, unnest(ts) AS term, len(ts)::BIGINT AS n FROM d) GROUP BY row, doc_id, term, n
), weights AS (
  SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, totals GROUP BY term, texts
), scored AS (
  SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * texts) // length))))::BIGINT AS score
  FROM q JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, row, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50"""

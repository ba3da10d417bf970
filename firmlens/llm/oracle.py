"""SQL counterparts of the operators that SQL can express."""

SHARDING = """
WITH docs AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
    lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)),
      60, '0') AS bits
  FROM documents),
depths AS (SELECT unnest(range(0, 25)) AS d),
sums AS (
  SELECT d, substr(bits, 1, d) AS prefix, sum(n_bytes) AS bytes, count(*) AS docs
  FROM docs, depths GROUP BY ALL),
leaves AS (
  SELECT docs.doc_id, docs.n_bytes, min(d) AS depth
  FROM docs JOIN sums ON substr(docs.bits, 1, d) = prefix
  WHERE bytes <= {limit} OR docs = 1
  GROUP BY ALL),
placed AS (
  SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, depth
  FROM leaves JOIN docs USING (doc_id, n_bytes))
SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth,
  CAST(sum(n_bytes) OVER w AS BIGINT) AS shard_bytes, count(*) OVER w AS shard_docs
FROM placed WINDOW w AS (PARTITION BY shard)
"""

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(md5(coalesce(text, '')) || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)
      AS BIGINT) AS key
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM docs GROUP BY source),
weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight,
    2e0 * source_size AS cap
  FROM named),
tried AS (
  SELECT *, cap / weight AS full_at,
    (1.5e0 * sum(source_size) OVER () - (sum(cap) OVER w - cap))
      / (sum(weight) OVER () - (sum(weight) OVER w - weight)) AS lv
  FROM weighted WINDOW w AS (ORDER BY cap / weight, place)),
goals AS (
  SELECT source, source_size,
    least(cap, weight * (SELECT lv FROM tried WHERE lv <= full_at ORDER BY full_at, place LIMIT 1))
      AS target
  FROM tried),
split AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole
  FROM goals),
keys AS (
  SELECT docs.source, key, target - whole * source_size AS rest, sum(docs.size) AS words
  FROM docs JOIN split ON docs.source IS NOT DISTINCT FROM split.source
  GROUP BY ALL),
running AS (
  SELECT source, key, rest, words,
    sum(words) OVER (PARTITION BY source ORDER BY key) AS upto
  FROM keys),
once_more AS (
  SELECT source, key FROM running
  WHERE upto <= rest OR (upto - words <= rest AND upto - rest < rest - (upto - words)))
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN once_more.key IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM docs JOIN split ON docs.source IS NOT DISTINCT FROM split.source
LEFT JOIN once_more
  ON docs.source IS NOT DISTINCT FROM once_more.source AND docs.key = once_more.key
"""

EMBED_DEDUP = """
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS MATERIALIZED (
  SELECT n, x FROM rows
  WHERE vec_id IS NOT NULL AND len([e FOR e IN x IF e IS NULL OR NOT isfinite(e)]) = 0
    AND len([e FOR e IN x IF e <> 0]) > 0),
links AS MATERIALIZED (
  SELECT a.n AS a, b.n AS b FROM usable a JOIN usable b ON a.n <> b.n AND len(a.x) = len(b.x)
  WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= 0.95e0 END),
reached AS (
  SELECT n, vec_id AS low FROM rows
  UNION
  SELECT b, low FROM reached JOIN links ON a = n),
grouped AS (SELECT n, min(low) AS component_id FROM reached GROUP BY n),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id,
  coalesce(vec_id = component_id, false) AS kept
FROM rows JOIN grouped USING (n) LEFT JOIN counted USING (n)
"""

# A document's shingles of two words; equal sets are one class.
MINHASH_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE
    list_sort(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) END AS s
  FROM texts),
classes AS MATERIALIZED (
  SELECT row_number() OVER () AS class, s, len(s) AS n, min(doc_id) AS first
  FROM sets WHERE len(s) > 0 GROUP BY s),
entries AS MATERIALIZED (SELECT class, n, unnest(s) AS e FROM classes),
links AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b
  FROM entries a JOIN entries b ON a.e = b.e AND a.class <> b.class
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
  SELECT class, first AS low FROM classes
  UNION
  SELECT b, low FROM reached JOIN links ON a = class),
grouped AS (SELECT class, min(low) AS low FROM reached GROUP BY class),
named AS (SELECT s, low FROM classes JOIN grouped USING (class))
SELECT doc_id, len(sets.s) AS n_shingles,
  CASE WHEN len(sets.s) > 0 THEN low ELSE doc_id END AS component_id,
  coalesce(doc_id = CASE WHEN len(sets.s) > 0 THEN low ELSE doc_id END, false) AS kept
FROM sets LEFT JOIN named ON sets.s = named.s
"""

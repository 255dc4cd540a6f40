"""SQL twins of the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pattern AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
place AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS p
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM pattern))),
hit AS (SELECT r, i, size, item FROM place JOIN pattern USING (size, p)),
words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + size)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP9 = """
WITH vec AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vec q JOIN vec c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pair) WHERE r <= 10
"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _plain(x: str) -> str:
    return rf"trim(regexp_replace({_LOWER.replace('text', x)}, '[\x20\x09-\x0D]+', ' ', 'g'))"


def _start(x: str) -> str:
    return f"length({x}) - length(ltrim({x}, {_WHITE}))"


# Units are sentences, lines and paragraphs of 12 words or more.
OP10 = rf"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS s FROM documents),
line AS MATERIALIZED (
  SELECT *, {_plain('raw')} AS n, coalesce(sum(length(raw) + 1) OVER (
           PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT r, doc_id, i, s[i] AS raw FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM doc))),
grouped AS MATERIALIZED (
  SELECT *, sum((n = '')::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM line),
piece AS MATERIALIZED (
  SELECT *, {_plain('part')} AS m, a + coalesce(sum(length(part)) OVER (
           PARTITION BY r, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT r, doc_id, i, g, a, p[j] AS part, j FROM (
    SELECT *, unnest(range(1, len(p) + 1)) AS j FROM (
      SELECT *, string_split(regexp_replace(raw, '([.!?])([\x20\x09])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p
      FROM grouped)))),
unit AS (
  SELECT r, doc_id, 'piece' AS kind, i, j, m AS n, b + {_start('part')} AS pos FROM piece
  UNION ALL SELECT r, doc_id, 'line', i, 0, n, a + {_start('raw')} FROM grouped
  UNION ALL SELECT r, doc_id, 'paragraph', g, 0, string_agg(n, ' ' ORDER BY i), min(a + {_start('raw')})
  FROM grouped WHERE n <> '' GROUP BY r, doc_id, g),
judged AS MATERIALIZED (
  SELECT *, rank() OVER (PARTITION BY n ORDER BY doc_id NULLS FIRST, pos) > 1 AS repeats
  FROM unit WHERE length(n) - length(replace(n, ' ', '')) >= 11),
gone AS MATERIALIZED (
  SELECT p.*, coalesce(x.repeats, false) OR coalesce(y.repeats, false) OR coalesce(z.repeats, false) AS goes
  FROM piece p
  LEFT JOIN judged x ON x.kind = 'piece' AND x.r = p.r AND x.i = p.i AND x.j = p.j
  LEFT JOIN judged y ON y.kind = 'line' AND y.r = p.r AND y.i = p.i
  LEFT JOIN judged z ON z.kind = 'paragraph' AND z.r = p.r AND z.i = p.g),
whole AS (SELECT r, i, bool_and(goes) AS whole FROM gone WHERE m <> '' GROUP BY r, i),
cut AS (
  SELECT r, a AS x, a + length(raw) AS y FROM grouped JOIN whole USING (r, i) WHERE whole
  UNION ALL
  SELECT r, b + {_start('part')}, b + length(rtrim(part, {_WHITE}))
  FROM gone JOIN whole USING (r, i) WHERE goes AND m <> '' AND NOT whole),
removed AS (
  SELECT r, CAST(count(*) AS INTEGER) AS n_removed, CAST(sum(y - x) AS INTEGER) AS removed_chars,
         string_agg(CAST(x AS BIGINT) || '-' || CAST(y AS BIGINT), ',' ORDER BY x) AS removed
  FROM cut GROUP BY r),
rest AS (
  SELECT r, i, string_agg(CASE WHEN goes AND m <> '' THEN left(part, {_start('part')})
                               || substr(part, length(rtrim(part, {_WHITE})) + 1) ELSE part END, '' ORDER BY j) AS raw
  FROM gone LEFT JOIN whole USING (r, i) WHERE NOT coalesce(whole, false) GROUP BY r, i),
kept AS (SELECT r, string_agg(raw, chr(10) ORDER BY i) AS kept FROM rest GROUP BY r),
counted AS (SELECT r, CAST(count(DISTINCT (pos, n)) AS INTEGER) AS n_units FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed,
       coalesce(removed_chars, 0) AS removed_chars, coalesce(removed, '') AS removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN counted USING (r) LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""

_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

# A table for each byte, then a CRC byte by byte, for each different word.
OP11 = rf"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
used AS MATERIALIZED (SELECT r, unnest(w) AS f FROM doc),
wanted AS MATERIALIZED (SELECT unnest({_WORDS}) AS f FROM benchmark),
byte AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))),
spelled AS MATERIALIZED (
  SELECT f, list_transform(range(1, length(hex(f)), 2), lambda p: CAST('0x' || substr(hex(f), p, 2) AS BIGINT)) AS b
  FROM (SELECT f FROM used UNION SELECT f FROM wanted)),
feature AS MATERIALIZED (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM spelled, byte),
source AS (SELECT bucket, count(*) AS n FROM used JOIN feature USING (f) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM wanted JOIN feature USING (f) GROUP BY bucket),
gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln(
           (coalesce(target.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM used) + 10000)::DOUBLE
           / ((source.n + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM source LEFT JOIN target USING (bucket)),
weighed AS (
  SELECT r, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM used JOIN feature USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (r)),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT count(place) * 10 // 100 FROM placed) THEN place END AS rank
FROM placed
"""


def _lloyd(rounds: int = 6) -> str:
    distance = "list_dot_product(x, x) - 2 * list_dot_product(x, y) + list_dot_product(y, y)"  # whole numbers
    steps = ""
    for k in range(rounds + 1):
        steps += f""",
a{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT r, p, e, x, {distance} AS d FROM part JOIN e{k} USING (p)) GROUP BY r, p)"""
        if k < rounds:
            steps += f""",
e{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(z, y) AS y FROM e{k} LEFT JOIN (
    SELECT p, e, list(m ORDER BY j) AS z FROM (
      SELECT p, best.e AS e, j, floor(sum(c) / count(*)) AS m
      FROM (SELECT p, best, unnest(x) AS c, unnest(range(len(x))) AS j FROM a{k}) GROUP BY ALL)
    GROUP BY p, e) USING (p, e))"""
    return steps


OP12 = f"""
WITH vec AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM (SELECT r, v, unnest(range(8)) AS p FROM vec)),
e0 AS MATERIALIZED (
  SELECT p, e, x AS y FROM part JOIN (
    SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM vec QUALIFY e < 16) USING (r)){_lloyd()},
made AS (
  SELECT r, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256((SELECT string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)
               FROM (SELECT p, e, unnest(y) AS c, unnest(range(len(y))) AS j FROM e6))) AS codebooks_sha256
FROM made JOIN vec USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": OP4,
    "op9_topk": OP9,
    "op10_lines": OP10,
    "op11_importance": OP11,
    "op12_codes": OP12,
}

"""The registered queries of this subpackage and their SQL, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import decontaminate
from .mixing import mix
from .packing import pack
from .partial_distance import compress
from .permutation import nearest_neighbours
from .prefix_trie import prefix_trie
from .quality import classify
from .revisits import captures, resolve_revisits
from .secrets import find_secrets
from .simhash import near_duplicates
from .substrings import shared_passages
from .toxicity import score_toxicity
from .viterbi import count_tokens


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumns({"headers": F.array_join(entries, "; "), "target_id": F.coalesce("target_id", F.lit(-1)), "target_ts": F.coalesce("target_ts", F.lit(-1))})


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substrings, op2_revisits, op3_secrets, op4_pack, op5_token_counts, op6_simhash, op7_permutation, op8_quality, op9_toxicity, op10_decontaminate, op11_partial_distance, op12_prefix_trie, op13_mixing)}


# The canonical URL is taken apart by places here, not by the operator's expressions.
OP2_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, page_id % 5 AS k, DATE '2024-01-01' + CAST(page_id // 1440 AS INTEGER) AS day, substr(url, instr(url, '://') + 3) AS rest,
         CASE page_id % 16 WHEN 10 THEN substr(url, instr(url, '://') + 3) WHEN 11 THEN 'mailto:p' || (page_id % 5) WHEN 12 THEN '//H.example:80/' || (page_id % 7) || '/'
              WHEN 13 THEN ' ' WHEN 14 THEN 'other.org/b?utm_x=1' WHEN 15 THEN 'FTP://' || substr(url, instr(url, '://') + 3) ELSE url END AS url
  FROM pages WHERE page_id IS NOT NULL),
c AS (
  SELECT page_id * 2 AS record_id, url, page_id AS ts, 200 AS status, '"' || left(digest, 16) || '"' AS etag, day AS lm, digest, page_id FROM p
  UNION ALL
  SELECT page_id * 2 + 1, split_part(url, '#', 1) || '#again', page_id + CASE WHEN k = 4 THEN -1 ELSE 7 END, 304,
         CASE WHEN page_id % 10 = 1 THEN '"other"' WHEN k = 0 THEN '"' || left(digest, 16) || '"' WHEN k = 1 THEN 'W/"' || left(digest, 16) || '"' END,
         CASE WHEN k = 2 THEN day END, NULL, page_id FROM p),
a AS (SELECT *, split_part(trim(url, ' '), '#', 1) AS bare FROM c),
b AS (SELECT *, CASE WHEN starts_with(bare, '//') THEN '' WHEN instr(bare, '://') > 1 AND length(translate(lower(split_part(bare, '://', 1)), 'abcdefghijklmnopqrstuvwxyz0123456789+.-', '')) = 0 THEN lower(split_part(bare, '://', 1)) END AS scheme FROM a),
e AS (SELECT *, substr(bare, instr(bare, '//') + 2) AS tail FROM b),
h AS (SELECT *, split_part(split_part(tail, '?', 1), '/', 1) AS authority, CASE WHEN instr(tail, '?') > 0 THEN substr(tail, instr(tail, '?') + 1) ELSE '' END AS query FROM e),
g AS (
  SELECT *, lower(authority) AS low, rtrim(substr(split_part(tail, '?', 1), length(authority) + 1), '/') AS path,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('gclid', 'fbclid', 'ref')
           AND NOT (starts_with(x, 'utm_') AND length(split_part(x, '=', 1)) > 4 AND length(translate(substr(split_part(x, '=', 1), 5), 'abcdefghijklmnopqrstuvwxyz', '')) = 0))), '&') AS params FROM h),
n AS (
  SELECT *, CASE WHEN scheme IS NULL OR authority = '' THEN nullif(bare, '') ELSE
         CASE WHEN scheme IN ('', 'http', 'https') THEN '//' ELSE scheme || '://' END
         || CASE WHEN ends_with(low, ':80') AND scheme IN ('', 'http') THEN left(low, length(low) - 3) WHEN ends_with(low, ':443') AND scheme IN ('', 'https') THEN left(low, length(low) - 4) ELSE low END
         || path || CASE WHEN params <> '' THEN '?' || params ELSE '' END END AS canonical_url FROM g),
j AS (
  SELECT r.record_id, r.canonical_url, r.etag, r.lm, r.page_id AS rp, f.record_id AS fid, f.ts AS fts, f.etag AS fetag, f.lm AS flm, f.digest AS fd
  FROM n r LEFT JOIN n f ON f.status = 200 AND f.canonical_url = r.canonical_url AND f.ts < r.ts
  WHERE r.status = 304
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) = 1),
s AS (
  SELECT *, CASE WHEN fid IS NULL THEN 'no_earlier'
    WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = fetag THEN 'resolved_etag' ELSE 'mismatch' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = flm THEN 'resolved_date' ELSE 'mismatch' END
    ELSE 'resolved_url' END AS state FROM j)
SELECT record_id, canonical_url, state,
       CASE WHEN state LIKE 'resolved%' THEN fid ELSE -1 END AS target_id,
       CASE WHEN state LIKE 'resolved%' THEN fts ELSE -1 END AS target_ts,
       CASE WHEN state LIKE 'resolved%' THEN fd END AS digest,
       CASE WHEN state LIKE 'resolved%' THEN 'cache-control=max-age=120; content-type=text/html; date=' || CAST(rp AS VARCHAR)
            || '; etag=' || fetag || '; x-cache=miss' END AS headers
FROM s
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k
        FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, k, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

def _op11_sql(rounds: int = 4) -> str:
    """Full searches: all distances between parts and entries, round by round."""
    steps = ["""k AS (
  SELECT vec_id, label, embedding AS e, len(embedding) // 4 AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, (i - 1) // d AS part, (i - 1) % d AS pos, CAST(floor(1024 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS c FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM k)),
b0 AS (
  SELECT part, rn - 1 AS entry, pos, c FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn FROM (SELECT DISTINCT vec_id FROM k)) USING (vec_id) WHERE rn <= 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, part, min(dist * 256 + entry) AS m FROM (
    SELECT v.vec_id, v.part, b.entry, sum((v.c - b.c) * (v.c - b.c)) AS dist FROM v JOIN b{r} b ON v.part = b.part AND v.pos = b.pos GROUP BY v.vec_id, v.part, b.entry)
  GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""n{r} AS (
  SELECT a.part, CAST(a.m % 256 AS BIGINT) AS entry, v.pos, CAST(floor(CAST(sum(v.c) AS DOUBLE) / count(*)) AS BIGINT) AS c
  FROM a{r} a JOIN v ON a.vec_id = v.vec_id AND a.part = v.part GROUP BY 1, 2, 3),
b{r + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry AND b.pos = n.pos)""")
    return "WITH " + ",\n".join(steps) + f""",
f AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 256 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT f.vec_id, f.code, f.error, l.label_error, h.codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h"""


# The checksum is folded over the bits of the decimal number.
OP12_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, max(p) AS n FROM t GROUP BY conv_id),
b AS (SELECT conv_id, n, list_concat(CAST([4294967295] AS BIGINT[]), list_transform(range(0, 8 * length(s)), lambda k: CAST((ascii(substr(s, CAST(k // 8 + 1 AS BIGINT), 1)) >> CAST(k % 8 AS INTEGER)) & 1 AS BIGINT))) AS bits FROM c),
h AS (SELECT conv_id, n, xor(list_reduce(bits, lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 6 AS h FROM b),
m AS (SELECT a.conv_id, a.h, a.conv_id - a.conv_id % 100 AS leader, least(a.h, coalesce(l.n, 0)) AS m FROM h a LEFT JOIN h l ON l.conv_id = a.conv_id - a.conv_id % 100),
r AS (
  SELECT t.conv_id, t.p - m.h + m.m AS p, role, text FROM t JOIN m ON t.conv_id = m.conv_id WHERE t.p > m.h
  UNION ALL SELECT m.conv_id, t.p, role, text FROM m JOIN t ON t.conv_id = m.leader WHERE t.p <= m.m),
x AS (SELECT conv_id, p AS d, length(text) AS points, list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY p) AS ks FROM r),
y AS (
  SELECT conv_id, d, points, array_to_string(ks[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], ',') END AS pk, ks FROM x
  UNION ALL SELECT conv_id, 0, 0, '', NULL, NULL FROM m),
e AS (SELECT conv_id, max(d) AS d FROM y GROUP BY conv_id),
z AS (SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM y JOIN e USING (conv_id, d) GROUP BY d, k),
n AS (SELECT d, k, any_value(pk) AS pk, any_value(ks) AS ks, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(points) AS own FROM y GROUP BY d, k),
g AS (SELECT n.d, n.k, n.pk, n.ks, n.conv_id, n.n_convs, n.own, count(ch.k) AS n_children FROM n LEFT JOIN n ch ON ch.d = n.d + 1 AND ch.pk = n.k GROUP BY ALL),
u AS (SELECT CASE WHEN a = 0 THEN '' ELSE array_to_string(ks[1:a], ',') END AS k, a AS d, own, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM g)),
f AS (SELECT d, k, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM u GROUP BY d, k)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, pa.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(g.n_children AS BIGINT) AS n_children,
       CAST(f.leaves AS BIGINT) AS n_leaves, CAST(f.saved AS BIGINT) AS saved_tokens, sha256(coalesce(z.ids, '')) AS ends_sha256
FROM g JOIN f ON f.d = g.d AND f.k = g.k LEFT JOIN n pa ON pa.d = g.d - 1 AND pa.k = g.pk LEFT JOIN z ON z.d = g.d AND z.k = g.k
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(t)) AS name,
         length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS letters, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS solid FROM d),
e AS (
  SELECT doc_id, source, size, name,
         -ln((CAST('0x' || left(name, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE)) / greatest(CAST(letters AS DOUBLE) / greatest(solid, 1), CAST(0.05 AS DOUBLE)) AS key FROM k),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS held, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM e GROUP BY source),
w AS (SELECT *, CAST(CASE rn % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
o AS (
  SELECT *, coalesce(sum(2 * held) OVER b, 0) AS gone, coalesce(sum(w) OVER b, 0) AS given, 1.5 * sum(held) OVER () AS budget, sum(w) OVER () AS weights
  FROM w WINDOW b AS (ORDER BY 2 * held / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (budget - gone) * w >= 2 * held * (weights - given) AS stops FROM o),
l AS (SELECT max(budget) - sum(CASE WHEN stops THEN 2 * held ELSE 0 END) AS rest, sum(CASE WHEN stops THEN 0 ELSE w END) AS open FROM c),
t AS (
  SELECT source, held, CAST(CASE WHEN stops THEN 2 * held ELSE w * rest / open END AS DOUBLE) AS target FROM c, l),
g AS (SELECT *, CASE WHEN held > 0 THEN floor(target / held) ELSE 0 END AS epochs FROM t),
r AS (SELECT e.*, g.held, g.target, g.epochs, floor(g.target - g.epochs * g.held + 0.5) AS words,
             coalesce(sum(size) OVER (PARTITION BY e.source ORDER BY key, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, r.source, size, CAST(held AS BIGINT) AS source_size, target, CAST(epochs * size + least(size, greatest(0, words - before)) AS BIGINT) AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_revisits": OP2_SQL, "op10_decontaminate": OP10_SQL, "op11_partial_distance": _op11_sql(), "op12_prefix_trie": OP12_SQL, "op13_mixing": OP13_SQL}

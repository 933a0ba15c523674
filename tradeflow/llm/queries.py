"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.llm import (decontaminate, language, mixing, negatives, neighbours, pii, repeats, secrets, sharding, simhash,
                           spelling, token_files, toxicity)
from tradeflow.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), exact_windows=True)


@_query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


@_query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_files.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def _listed(spans, kinds):
    """kind:start:end, comma-joined in the order of the spans."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, k: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
                        F.sha2(_listed("base", pii.KINDS), 256).alias("base_sha256"),
                        _listed("spans", pii.KINDS).alias("spans"))


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *[_count("spans", k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])],
                        F.sha2(_listed(base, secrets.KINDS), 256).alias("base_sha256"),
                        _listed("spans", secrets.KINDS).alias("spans"))


@_query
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(language.fold() == 2, F.lit(False))
    found = language.identified(read(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


@_query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


# windows as hex text, two letters a byte; runs of repeated windows that touch make one span
ORACLES["op2_repeats"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, CAST(2 * p + 1 AS BIGINT), 800)) AS k
      FROM (SELECT doc_id, h, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS s FROM r),
i AS (SELECT doc_id, sum(s) OVER (PARTITION BY doc_id ORDER BY p) AS g, p FROM g),
x AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY doc_id, g),
c AS (SELECT d.doc_id, d.n, d.h, coalesce(x.a, d.n) AS a, x.b, lag(x.b, 1, 0) OVER (PARTITION BY d.doc_id ORDER BY x.a) AS before,
             lead(x.a, 1, d.n) OVER (PARTITION BY d.doc_id ORDER BY x.a) AS next FROM d LEFT JOIN x USING (doc_id)),
k AS (SELECT doc_id, any_value(n) AS n, coalesce(sum(b - a), 0) AS gone, count(b) AS spans,
             string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a)
             || CASE WHEN count(b) > 0 THEN substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) ELSE '' END AS kept
      FROM c GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
       sha256(unhex(kept)) AS kept_sha256 FROM k"""


# scores are whole numbers under 2^53, so the inner product of doubles is exact
ORACLES["op13_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS other, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

# the checksum byte by byte (À to ÿ are two bytes); near words share a variant with one code point left out in the same
# place, or one of them is such a variant of the other
ORACLES["op12_spelling"] = """
WITH RECURSIVE tbl AS (
  SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384)
                                                              ELSE a >> 1 END, i) AS t FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
k AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, c, xor(list_reduce(flatten(list_transform(string_split(id || ':' || run, ''),
                       lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END)),
                     lambda a, b: xor(tbl.t[xor(a & 255, b) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM k, tbl),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, min(e.near) AS form, CASE WHEN min(e.near) IS NOT NULL THEN any_value(b.m) END AS form_n
      FROM w LEFT JOIN b ON b.word = w.word LEFT JOIN e ON e.word = w.word AND e.m = b.m AND b.m >= 5 * w.n GROUP BY ALL),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.*, r.at AS root FROM f JOIN r ON r.word = f.word JOIN f AS last ON last.word = r.at WHERE last.form IS NULL"""

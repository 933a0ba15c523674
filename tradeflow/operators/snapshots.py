"""Quality across snapshots: what the tables of a run looked like, stored, and the documented rules
checked against the stored run before it.

``take`` writes, per watched table, its key counts (one row per key) and a few
metric rows: row count, an order-insensitive digest (the sum of the rows' 64-bit
hashes), the schema as text, rows per source, rows dated before the business
start. Every table is read once for its metrics and once for its keys, with
partial aggregates only. ``compare`` reads two stored runs and yields check rows
like :mod:`tradeflow.operators.quality`; names are compared by anti-joins both ways.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUSINESS_START = dt.date(2019, 2, 22)  # fixed value of the documented rule
METRICS = "table string, metric string, detail string, number decimal(38,0), text string"
KEYS = "table string, key string, n long"


@dataclass(frozen=True)
class Watched:
    """A table of a run; ``dates`` are checked against the business start."""

    df: DataFrame
    key: str | None = None
    source: str | None = None
    dates: Sequence[str] = field(default_factory=tuple)


def schema_text(df: DataFrame) -> str:
    """Names and types in order: two schemas are equal if their texts are."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _metrics(name: str, w: Watched, start: dt.date) -> DataFrame:
    source = F.col(w.source).cast("string") if w.source else F.lit(None).cast("string")
    digest = F.sum(F.xxhash64(*w.df.columns).cast("decimal(38,0)"))
    before = [F.count(F.when(F.col(c).cast("date") < F.lit(start), 1)).alias(f"_before_{i}") for i, c in enumerate(w.dates)]
    per = w.df.groupBy(source.alias("_source")).agg(F.count(F.lit(1)).alias("_n"), digest.alias("_digest"), *before)
    number = lambda c: c.cast("decimal(38,0)")
    row = lambda metric, detail, value: F.struct(
        F.lit(metric).alias("metric"), detail.cast("string").alias("detail"), number(value).alias("number"))
    rows = [row("source", F.col("_source"), F.col("_n")), row("rows", F.lit(None), F.col("_n")),
            row("digest", F.lit(None), F.col("_digest")),
            *[row("before", F.lit(c), F.col(f"_before_{i}")) for i, c in enumerate(w.dates)]]
    out = per.select(F.explode(F.array(*rows)).alias("m")).select("m.*").groupBy("metric", "detail").agg(number(F.sum("number")).alias("number"))
    found = out.select(F.lit(name).alias("table"), "metric", "detail", "number", F.lit(None).cast("string").alias("text"))
    schema = w.df.sparkSession.createDataFrame([(name, "schema", None, None, schema_text(w.df))], METRICS)
    return found.unionByName(schema)


def take(spark: SparkSession, path: str, watched: Mapping[str, Watched], *, start: dt.date = BUSINESS_START) -> None:
    """Stores a run at ``path`` (a run that is taken again replaces it)."""
    metrics = keys = None
    for name, w in watched.items():
        own = _metrics(name, w, start)
        metrics = own if metrics is None else metrics.unionByName(own)
        if w.key:
            own = w.df.select(F.lit(name).alias("table"), F.col(w.key).cast("string").alias("key")) \
                .groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
            keys = own if keys is None else keys.unionByName(own)
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    (keys if keys is not None else spark.createDataFrame([], KEYS)).write.mode("overwrite").parquet(f"{path}/keys")


@dataclass(frozen=True)
class Rule:
    """kind: grows | constant (rows, or rows of ``detail`` as source), unique, same_names (of ``table`` and ``detail``),
    not_more (keys of ``table`` than of ``detail``), kept_names (since the run before), not_before (date ``detail``), schema."""

    kind: str
    table: str
    detail: str | None = None
    severity: str = "error"

    @property
    def check(self) -> str:
        return f"{self.kind}:{self.detail}" if self.detail else self.kind


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(METRICS).parquet(f"{path}/metrics"), spark.read.schema(KEYS).parquet(f"{path}/keys")


def compare(spark: SparkSession, before: str, now: str, rules: Sequence[Rule]) -> DataFrame:
    """One check row per rule: (table, check, severity, passed, observed, threshold). What a rule needs and a run does
    not hold reads as no rows; a table whose schema is not in both runs fails ``schema``."""
    old, old_keys = _read(spark, before)
    new, new_keys = _read(spark, now)
    rule = spark.createDataFrame([(i, r.kind, r.table, r.detail, r.severity, r.check) for i, r in enumerate(rules)],
                                 "id int, kind string, table string, detail string, severity string, check string")
    # metric rows of both runs, summed up to one row per (table, metric, detail): a handful per table
    both = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    per = both.groupBy("table", "metric", "detail").agg(
        *[F.coalesce(F.sum(F.when(F.col("_old") == o, F.col("number"))), F.lit(0)).cast("double").alias(n) for n, o in (("was", 1), ("is", 0))],
        *[F.max(F.when(F.col("_old") == o, F.col("text"))).alias(n) for n, o in (("was_text", 1), ("is_text", 0))])
    metric = F.when(F.col("kind") == "schema", "schema").when(F.col("kind") == "not_before", "before") \
        .when(F.col("detail").isNull(), "rows").otherwise("source")
    measured = rule.filter(F.col("kind").isin("grows", "constant", "not_before", "schema")).withColumn("metric", metric)
    m = measured.alias("r").join(per.alias("m"), (F.col("r.table") == F.col("m.table")) & (F.col("r.metric") == F.col("m.metric"))
                                 & F.col("r.detail").eqNullSafe(F.col("m.detail")), "left")
    was, is_ = F.coalesce("m.was", F.lit(0.0)), F.coalesce("m.is", F.lit(0.0))
    passed = (F.when(F.col("r.kind") == "grows", is_ >= was).when(F.col("r.kind") == "constant", is_ == was)
              .when(F.col("r.kind") == "not_before", is_ == 0).otherwise(F.coalesce(F.col("m.was_text") == F.col("m.is_text"), F.lit(False))))
    observed = F.when(F.col("r.kind") != "schema", is_)
    threshold = F.when(F.col("r.kind").isin("grows", "constant"), was).when(F.col("r.kind") == "not_before", 0.0)
    out = m.select("r.table", "r.check", "r.severity", passed.alias("passed"), observed.alias("observed"), threshold.alias("threshold"))

    # key rules: what breaks them is counted by anti-joins, one for each pair of tables
    one = lambda df, r, ok, bad, limit: df.agg(bad.cast("double").alias("observed"), limit.cast("double").alias("threshold")).select(
        F.lit(r.table).alias("table"), F.lit(r.check).alias("check"), F.lit(r.severity).alias("severity"),
        ok(F.col("observed"), F.col("threshold")).alias("passed"), "observed", "threshold")
    zero = lambda o, t: o <= t
    for r in rules:
        own = new_keys.filter(F.col("table") == r.table).select("key", "n")
        if r.kind == "unique":
            out = out.unionByName(one(own, r, zero, F.coalesce(F.sum(F.col("n") - 1), F.lit(0)), F.lit(0)))
        elif r.kind in ("same_names", "kept_names"):
            other = (new_keys.filter(F.col("table") == r.detail) if r.kind == "same_names" else old_keys.filter(F.col("table") == r.table)).select("key", "n")
            gone = _absent(other, own)
            bad = gone.unionByName(_absent(own, other)) if r.kind == "same_names" else gone
            out = out.unionByName(one(bad, r, zero, F.count(F.lit(1)), F.lit(0)))
        elif r.kind == "not_more":
            tagged = own.select(F.lit(1).alias("a"), "n").unionByName(new_keys.filter(F.col("table") == r.detail).select(F.lit(0).alias("a"), "n"))
            rows = lambda a: F.coalesce(F.sum(F.when(F.col("a") == a, F.col("n"))), F.lit(0))
            out = out.unionByName(one(tagged, r, zero, rows(1), rows(0)))
    return out


def _absent(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of ``a`` that ``b`` does not hold as often; null is a key like any other."""
    same: Column = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.n") == F.col("b.n"))
    return a.alias("a").join(b.alias("b"), same, "left_anti").select("key")

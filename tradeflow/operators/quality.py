"""Data-quality checks.

Every check yields rows ``(table, check, severity, passed, observed,
threshold)``. All metrics of one table come from ONE aggregate over it
(one scan); the rows are then produced by ``stack`` on that single-row
result, so no per-check pass over the data is made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECK_SCHEMA = "table string, check string, severity string, passed boolean, observed double, threshold double"


def _rows(metrics: DataFrame, table: str, checks: Sequence[tuple[str, str, Column, Column, float | None]]) -> DataFrame:
    """checks: (name, severity, passed expr, observed expr, threshold) over the one-row metrics."""
    structs = [F.struct(F.lit(table).alias("table"), F.lit(n).alias("check"), F.lit(s).alias("severity"),
                        p.cast("boolean").alias("passed"), o.cast("double").alias("observed"),
                        F.lit(t).cast("double").alias("threshold"))
               for n, s, p, o, t in checks]
    return metrics.select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def schema_check(df: DataFrame, table: str, expected: T.StructType) -> DataFrame:
    """DQ1: missing column -> error; unexpected column or type mismatch -> warning.
    Driver-side comparison of two schemas (metadata only, no scan)."""
    spark = df.sparkSession
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in expected.fields}
    rows = []
    for n, t in want.items():
        if n not in have:
            rows.append((table, f"missing:{n}", "error", False, None, None))
        elif have[n] != t:
            rows.append((table, f"type:{n}", "warning", False, None, None))
    for n in have:
        if n not in want:
            rows.append((table, f"unexpected:{n}", "warning", False, None, None))
    if not rows:
        rows.append((table, "schema", "info", True, None, None))
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def job_card_checks(cards: DataFrame, *, title: str = "card_title", card_id: str = "card_id",
                    required: Sequence[str] = ("card_title", "card_id", "status")) -> DataFrame:
    """DQ2: non-empty, required columns, digit-title share >= 50 %, no duplicate ids."""
    # a column that is not there gives no figure, and the check on it fails
    there = lambda c, figure: figure if c in cards.columns else F.lit(None).cast("long")
    m = cards.agg(F.count(F.lit(1)).alias("n"),
                  there(title, F.count(F.when(F.col(title).rlike(r"^\d"), 1))).alias("n_digit"),
                  there(card_id, F.count_distinct(card_id)).alias("n_ids"))
    missing = [c for c in required if c not in cards.columns]
    pct = F.when(F.col("n") > 0, F.col("n_digit") * 100.0 / F.col("n")).otherwise(F.lit(0.0))
    return _rows(m, "job_cards", [
        ("non_empty", "error", F.col("n") > 0, F.col("n"), 1.0),
        ("required_columns", "error", F.lit(not missing), F.lit(len(missing)), 0.0),
        ("job_title_share_pct", "warning", F.coalesce(pct >= 50, F.lit(False)), pct, 50.0),
        ("duplicate_ids", "warning", F.coalesce(F.col("n") - F.col("n_ids") == 0, F.lit(False)), F.col("n") - F.col("n_ids"), 0.0),
    ])


def quote_checks(quotes: DataFrame, *, total: str = "line_total", source: str = "quote_source",
                 max_share_pct: float = 95.0) -> DataFrame:
    """DQ3: negative and zero totals (count and %), source skew > 95 %."""
    # one scan: per-source partial counts, then one row over the (few) sources
    by_src = quotes.groupBy(source).agg(F.count(F.lit(1)).alias("_n"),
                                        F.count(F.when(F.col(total) < 0, 1)).alias("_neg"),
                                        F.count(F.when(F.col(total) == 0, 1)).alias("_zero"))
    m = by_src.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_neg"), F.lit(0)).alias("n_neg"),
                   F.coalesce(F.sum("_zero"), F.lit(0)).alias("n_zero"),
                   F.coalesce(F.max("_n"), F.lit(0)).alias("n_top_source"))
    pct = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) * 100.0 / F.col("n"), 2)).otherwise(F.lit(0.0))
    return _rows(m, "quotes", [
        ("non_empty", "error", F.col("n") > 0, F.col("n"), 1.0),
        ("negative_totals_pct", "info", F.col("n_neg") == 0, pct("n_neg"), 0.0),
        ("zero_totals_pct", "info", F.col("n_zero") == 0, pct("n_zero"), 0.0),
        ("source_skew_pct", "warning", pct("n_top_source") <= max_share_pct, pct("n_top_source"), max_share_pct),
    ])


def business_checks(projects: DataFrame, *, max_quote: float = 10_000_000.0) -> DataFrame:
    """DQ5: negative money, quotes over 10 M, negative-margin share > 25 %, no-labour share > 80 %."""
    m = projects.agg(F.count(F.lit(1)).alias("n"),
                     F.count(F.when((F.col("total_quote_value") < 0) | (F.col("supplier_costs_total") < 0), 1)).alias("n_neg"),
                     F.count(F.when(F.col("total_quote_value") > max_quote, 1)).alias("n_big"),
                     F.count(F.when(F.col("gp_margin_pct") < 0, 1)).alias("n_neg_margin"),
                     F.count(F.when(F.coalesce(F.col("labour_hours"), F.lit(0.0)) == 0, 1)).alias("n_no_labour"))
    pct = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) * 100.0 / F.col("n"), 2)).otherwise(F.lit(0.0))
    return _rows(m, "projects", [
        ("negative_money", "warning", F.col("n_neg") == 0, F.col("n_neg"), 0.0),
        ("quote_over_limit", "warning", F.col("n_big") == 0, F.col("n_big"), max_quote),
        ("negative_margin_pct", "warning", pct("n_neg_margin") <= 25, pct("n_neg_margin"), 25.0),
        ("no_labour_pct", "warning", pct("n_no_labour") <= 80, pct("n_no_labour"), 80.0),
    ])


def consistency_checks(cards: DataFrame, jobs: DataFrame, mapping: DataFrame, projects: DataFrame,
                       *, min_match_pct: float = 92.0) -> DataFrame:
    """DQ4 + DQ7: jobs <= cards, projects <= jobs, conversion >= 50 %, quote match
    coverage >= 92 %, unique job names. Each side is one aggregate."""
    def kv(df: DataFrame, **metrics: Column) -> DataFrame:
        one = df.agg(*[v.alias(k) for k, v in metrics.items()])
        return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in metrics]),
                                                      F.array(*[F.col(k).cast("double") for k in metrics])))
                          .alias("metric", "value"))
    parts = kv(cards, n_cards=F.count(F.lit(1))) \
        .unionByName(kv(jobs, n_jobs=F.count(F.lit(1)), n_job_names=F.count_distinct("name"))) \
        .unionByName(kv(mapping, n_matched=F.count_distinct(F.when(F.col("match_type") != "no_match",
                                                                   F.col("job_name"))),
                        n_mapped=F.count_distinct("job_name"))) \
        .unionByName(kv(projects, n_projects=F.count(F.lit(1))))
    names = ["n_cards", "n_jobs", "n_job_names", "n_matched", "n_mapped", "n_projects"]
    m = parts.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    conv = F.when(F.col("n_cards") > 0, F.round(F.col("n_jobs") * 100.0 / F.col("n_cards"), 2)).otherwise(0.0)
    cov = F.when(F.col("n_mapped") > 0, F.round(F.col("n_matched") * 100.0 / F.col("n_mapped"), 2)).otherwise(0.0)
    return _rows(m, "pipeline", [
        ("jobs_le_cards", "error", F.col("n_jobs") <= F.col("n_cards"), F.col("n_jobs"), None),
        ("projects_le_jobs", "error", F.col("n_projects") <= F.col("n_jobs"), F.col("n_projects"), None),
        ("conversion_pct", "warning", conv >= 50, conv, 50.0),
        ("match_coverage_pct", "warning", cov >= min_match_pct, cov, min_match_pct),
        ("unique_job_names", "error", F.col("n_jobs") == F.col("n_job_names"), F.col("n_jobs") - F.col("n_job_names"), 0.0),
    ])


def volume_check(df: DataFrame, table: str, min_rows: int = 10_000) -> DataFrame:
    """DQ8: row-count warning below a threshold."""
    m = df.agg(F.count(F.lit(1)).alias("n"))
    return _rows(m, table, [("min_volume", "warning", F.col("n") >= min_rows, F.col("n"), float(min_rows))])


def suite(*checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DQ6: all check rows, plus one summary row (errors, warnings, overall pass)."""
    allc = checks[0]
    for c in checks[1:]:
        allc = allc.unionByName(c)
    summary = allc.agg(
        F.count(F.when(~F.col("passed") & (F.col("severity") == "error"), 1)).alias("n_errors"),
        F.count(F.when(~F.col("passed") & (F.col("severity") == "warning"), 1)).alias("n_warnings"),
        F.count(F.lit(1)).alias("n_checks")).withColumn("passed", F.col("n_errors") == 0)
    return allc, summary


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                names: Sequence[str] = ("n_left", "n_right", "n_both")) -> DataFrame:
    """DQ4: distinct keys of two tables and how many they share (one row)."""
    tagged = left.select(F.col(left_key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(right_key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))).filter("k is not null")
    per = tagged.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(
        (F.col("l"), F.col("r"), F.col("l") * F.col("r")), names)])

"""Aggregations.

All per-key work is a ``groupBy`` with partial (map-side) aggregation:
``sum``/``min_by``/``max_by``/``count`` combine before the shuffle, so a key
holding a third of the rows costs one partial row per task, not a third of
the data in one task. List-valued results are returned as bridge rows
(key, element) — never as one unbounded array per key — and the
"ordered list" semantics is carried by an explicit order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedup_report(df: DataFrame, distinct_keys: Sequence[str] = ()) -> DataFrame:
    """Exact duplicate removal on all columns, reported as one row of counts
    (plus ``n_<key>s`` distinct key counts). One shuffle: rows are counted per
    distinct row, then a global aggregate runs over the distinct rows."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    extra = [F.count_distinct(k).alias(f"n_{k}s") for k in distinct_keys]
    return counted.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), *extra) \
        .withColumn("n_removed", F.col("n_rows") - F.col("n_distinct"))


def drop_exact_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct rows, surplus copies). The surplus side keeps one row per
    extra copy so kept ∪ removed has the input's multiset size."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    kept = counted.drop("_n")
    removed = counted.filter(F.col("_n") > 1) \
        .withColumn("_rep", F.explode(F.sequence(F.lit(2), F.col("_n")))).drop("_n", "_rep")
    return kept, removed


def labour_per_key(labour: DataFrame, key: str = "name", hours: str = "total_hours",
                   person: str = "employee", **more: Column) -> DataFrame:
    """A3: per job: total hours (rounded 2), distinct staff count, record count; ``more``: other aggregates by name."""
    return labour.groupBy(key).agg(
        F.round(F.sum(hours), 2).alias("labour_hours"),
        F.count_distinct(person).alias("n_site_staff"),
        F.count(F.lit(1)).alias("n_labour_records"),
        *[c.alias(n) for n, c in more.items()],
    )


def hours_per_person(labour: DataFrame, key: str = "name", person: str = "employee",
                     hours: str = "total_hours") -> DataFrame:
    """A4: (job, employee) -> summed hours, as bridge rows (the 'map' of the reference)."""
    return labour.groupBy(key, person).agg(F.round(F.sum(hours), 2).alias("hours"))


def last_seen_per_key(df: DataFrame, key: str, order: str, col: str, alias: str | None = None) -> DataFrame:
    """Per key the last non-null value in member order."""
    return df.groupBy(key).agg(
        F.expr(f"max_by(`{col}`, `{order}`) FILTER (WHERE `{col}` IS NOT NULL)").alias(alias or col))


def ordered_members(df: DataFrame, key: str, order: str, member: str) -> DataFrame:
    """A5/A14 ordered list as bridge rows with a 1-based position per key.

    The window sorts within a key (spilling to disk if a key is huge); the
    project roll-up itself uses ``min_by``/``max_by`` aggregates instead.
    """
    w = Window.partitionBy(key).orderBy(order, member)
    return df.select(key, member, order).withColumn("pos", F.row_number().over(w))


def distinct_values(df: DataFrame, key: str, col: str) -> DataFrame:
    """A14 set union across members: distinct (key, value) bridge rows."""
    return df.select(key, col).filter(F.col(col).isNotNull()).distinct()


def exact_median_and_mean(values: DataFrame, col: str, median_alias: str = "median",
                          mean_alias: str = "mean") -> DataFrame:
    """Exact median (``percentile_cont(0.5)``) and ``round(avg, 2)`` of an
    integer-valued column (day differences).

    Distributed: values are first counted per distinct value (partial
    aggregation), so only the histogram — bounded by the value range, not
    the row count — is ordered to locate the middle rank(s).
    """
    hist = values.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    j = (hist.withColumn("_cum", F.sum("_n").over(w))
         .withColumn("_tot", F.sum("_n").over(everything))
         .withColumn(mean_alias, F.round(F.sum(F.col(col) * F.col("_n")).over(everything) / F.col("_tot"), 2)))
    # 0-based ranks of the two middle elements
    lo = F.floor((F.col("_tot") - 1) / 2)
    hi = F.ceil((F.col("_tot") - 1) / 2)
    pick = j.select(
        F.when((F.col("_cum") - F.col("_n") <= lo) & (lo < F.col("_cum")), F.col(col)).alias("_lo"),
        F.when((F.col("_cum") - F.col("_n") <= hi) & (hi < F.col("_cum")), F.col(col)).alias("_hi"),
        mean_alias)
    return pick.agg(((F.max("_lo") + F.max("_hi")) / 2.0).alias(median_alias), F.max(mean_alias).alias(mean_alias))


def counts_with_empty(groups: DataFrame, items: DataFrame, key: str, alias: str = "n") -> DataFrame:
    """Item count per group including groups with no items (0)."""
    c = items.groupBy(key).agg(F.count(F.lit(1)).alias(alias))
    return groups.join(c, key, "left").withColumn(alias, F.coalesce(F.col(alias), F.lit(0)))


def share_of_total(df: DataFrame, key: str, alias: str = "share") -> DataFrame:
    """Per group count, and its share of all rows (window over the small
    per-group result, not over the input)."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn(alias, F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def count_distinct(df: DataFrame, col: str | Column, alias: str = "n_distinct") -> DataFrame:
    """A19 distinct count (exact; ``approx_count_distinct`` is opt-in elsewhere)."""
    return df.agg(F.count_distinct(col).alias(alias))

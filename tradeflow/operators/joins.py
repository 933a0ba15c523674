"""Equi-join operators.

Each operator returns lazy DataFrames; where the reference silently drops or
raises on unmatched rows, we return ``(kept, rejected)`` pairs (K4). Lookup
sides are left to AQE, which broadcasts one when its measured size is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeflow.session import dealt, written


def explode_ids_lookup(tasks: DataFrame, people: DataFrame, projects: DataFrame, *,
                       ids_col: str = "people_ids", id_col: str = "people_id",
                       person_key: str = "people_id", person_name: str = "name",
                       project_key: str = "project_id", project_name: str = "name",
                       task_name: str = "name") -> tuple[DataFrame, DataFrame]:
    """One row per person of a booking, person id -> name, blank task name -> project name.

    ``ids_col`` non-null -> one row per id, else the single ``id_col``.
    Unknown person ids go to the rejected side (the reference raises).
    Returns ``(rows, rejected)``; rows carry ``employee`` and the resolved ``name``.
    """
    exploded = tasks.withColumn(
        "_pid", F.explode(F.coalesce(F.col(ids_col), F.array(F.col(id_col))))
    ).drop(ids_col, id_col)
    # lookup sides are left to AQE (runtime size decides broadcast vs shuffle)
    ppl = people.select(F.col(person_key).alias("_pid"), F.col(person_name).alias("employee"))
    prj = projects.select(F.col(project_key).alias("_prj"), F.col(project_name).alias("_pname"))
    resolved = exploded.join(ppl, "_pid", "left")
    resolved = resolved.join(prj, resolved[project_key] == prj["_prj"], "left").drop("_prj")
    blank = F.col(task_name).isNull() | (F.trim(F.col(task_name)) == "")
    resolved = resolved.withColumn(task_name, F.when(blank, F.col("_pname")).otherwise(F.col(task_name))).drop("_pname")
    kept = resolved.filter(F.col("employee").isNotNull()).drop("_pid")
    rejected = resolved.filter(F.col("employee").isNull()).withColumnRenamed("_pid", "unknown_person_id") \
        .withColumn("reason", F.lit("unknown_person"))
    return kept, rejected


def match_type(ref: str | Column, words: Sequence[str] = ("variation", "private")) -> Column:
    """J3: 'variation' when the lower-cased reference contains any of ``words``, else 'primary'."""
    r = F.lower(F.col(ref) if isinstance(ref, str) else ref)
    cond = F.lit(False)
    for w in words:
        cond = cond | r.contains(w)
    return F.when(cond, F.lit("variation")).otherwise(F.lit("primary"))


def anti_join(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key tuple is absent from ``other`` (null keys never match)."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def left_join_with_gap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left join plus the gap table (left rows without a right match)."""
    return left.join(right, list(keys), "left"), left.join(right.select(*keys), list(keys), "left_anti")


def outer_merge(left: DataFrame, right: DataFrame, on: Sequence[str], *,
                prefer_left: Sequence[str] = (), prefer_right: Sequence[str] = (),
                left_only: Sequence[str] = (), right_only: Sequence[str] = (),
                tag: tuple[str, str, str] | None = None) -> DataFrame:
    """FULL OUTER join with COALESCE per column and a provenance tag.

    ``tag = (column, left_label, right_label)``: left_label only when the
    right side is missing, right_label whenever the right side matched.
    """
    l = left.alias("l")
    r = right.alias("r")
    cond = None
    for k in on:
        c = F.col(f"l.{k}") == F.col(f"r.{k}")
        cond = c if cond is None else cond & c
    j = l.join(r, cond, "full_outer")
    cols = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in on]
    cols += [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in prefer_left]
    cols += [F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) for c in prefer_right]
    cols += [F.col(f"l.{c}").alias(c) for c in left_only]
    cols += [F.col(f"r.{c}").alias(c) for c in right_only]
    if tag:
        name, lt, rt = tag
        right_missing = F.col(f"r.{on[0]}").isNull()
        cols.append(F.when(right_missing, F.lit(lt)).otherwise(F.lit(rt)).alias(name))
    return j.select(*cols)


def occurrences(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "occurrence") -> DataFrame:
    """``df`` with the place of each row among the rows of its key, from 0, in the given order (ties in any order among
    rows equal in it). The rows are written once and counted by key. Keys of up to ``HOT_ROWS`` rows are numbered by a
    window; the rows of the others, if any, are dealt by ranges of (key, order) and written, so that a key with a large
    share of the rows is numbered by many tasks: places within a range, plus the key's rows in the ranges before."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    df = written(df, "to-number")
    hot = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS).drop("_n"), "hot-keys")
    window = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1
    rows = df.count()
    if hot.isEmpty():
        return dealt(df, rows, *keys).withColumn(name, window)
    hot = F.broadcast(hot)  # HOT_ROWS rows each: few keys
    same = reduce(Column.__and__, [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys])
    plain = dealt(df.alias("d").join(hot.alias("h"), same, "left_anti"), rows, *keys).withColumn(name, window)
    return plain.unionByName(_ranged(df.alias("d").join(hot.alias("h"), same, "left_semi"), keys, by, name))


HOT_ROWS = 1 << 18


def _ranged(df: DataFrame, keys: Sequence[str], by: Sequence[Column], name: str) -> DataFrame:
    dealt = written(df.repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()), "occurrences")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]  # ranges are fixed: both readers see the same
    per = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*by)) - 1
    cond = reduce(Column.__and__, same, F.col("d._range") == F.col("p._range"))
    numbered = dealt.withColumn("_inner", inner).alias("d").join(per.alias("p"), cond)
    return numbered.select("d.*", (F.col("_inner") + F.col("_before")).alias(name)).drop("_range", "_inner")


def aligned_merge(left: DataFrame, right: DataFrame, on: Sequence[str], *, left_order: Sequence[str | Column],
                  right_order: Sequence[str | Column], columns: Mapping[str, Column], tag: tuple[str, str, str]) -> DataFrame:
    """J8 on lines: the n-th row of a key on the left meets the n-th on the right, and rows without a partner stay alone:
    max(lines) rows per key instead of lines x lines. ``columns`` maps output names to columns over the sides
    ``l`` and ``r``; ``tag`` as in :func:`outer_merge`. Null keys meet nothing."""
    l = occurrences(left, on, left_order).withColumn("_there", F.lit(True)).alias("l")
    r = occurrences(right, on, right_order).withColumn("_there", F.lit(True)).alias("r")
    cond = F.col("l.occurrence") == F.col("r.occurrence")
    for k in on:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    name, left_label, right_label = tag
    return l.join(r, cond, "full_outer").select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in on],
        F.coalesce("l.occurrence", "r.occurrence").alias("occurrence"), *[c.alias(n) for n, c in columns.items()],
        F.when(F.col("r._there").isNull(), left_label).otherwise(right_label).alias(name))


def resolve_link_urls(links: DataFrame, cards: DataFrame, *, name_col: str = "job_name", url_col: str = "url",
                      id_col: str = "short_url", path_segment: int = 2) -> tuple[DataFrame, DataFrame]:
    """Linked-card URL -> path segment ``path_segment`` (0-based after the
    leading '/') -> card id -> card name. ``links`` has one row per (card name,
    URL). Returns ``(edges(src, dst), unresolved)``."""
    from tradeflow.functions.text import url_part
    ex = links.select(F.col(name_col).alias("src"), F.col(url_col).alias("link_url"))
    ex = ex.withColumn("link_id", F.try_element_at(F.split(url_part("link_url", "path"), "/"),
                                                   F.lit(path_segment + 1)))
    names = cards.select(F.col(id_col).alias("link_id"), F.col(name_col).alias("dst"))
    j = ex.join(names, "link_id", "left")
    return (j.filter(F.col("dst").isNotNull()).select("src", "dst"),
            j.filter(F.col("dst").isNull()).select(F.col("src").alias("card"), "link_url",
                                                   F.lit("attached_card_not_a_job").alias("reason")))


def rehydrate(members: DataFrame, entities: DataFrame, *, member_key: str, entity_key: str,
              group: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(group, member id) bridge rows -> entity rows.

    Default drops only unknown ids (reported in the second frame). With
    ``strict=True`` a group with any unknown id loses all its members, as
    the reference does (Q7).
    """
    j = members.join(entities.withColumn("_known", F.lit(True)),
                     members[member_key] == entities[entity_key], "left")
    unknown = j.filter(F.col("_known").isNull()).select(group, member_key)
    kept = j.filter(F.col("_known").isNotNull()).drop("_known")
    if strict:
        kept = kept.join(unknown.select(group).distinct(), group, "left_anti")
    return kept, unknown


def attach_rows(entities: DataFrame, rows: DataFrame, *, entity_key: str, row_key: str) -> DataFrame:
    """Rows of a second table that belong to each entity, as bridge rows
    (entity columns repeated); entities without rows are kept once with nulls."""
    return entities.join(rows, entities[entity_key] == rows[row_key], "left")


def rate_lookup(rates_wide: DataFrame, work: DataFrame, *, code_col: str = "lookup_code",
                work_code: str = "code", who_col: str = "sub", order_col: str) -> tuple[DataFrame, DataFrame]:
    """Per (work code, subcontractor) the rate from a wide rate table.

    The wide table is unpivoted into (code, sub, rate); the first row of a
    code wins (smallest ``order_col``, the file position of the export); work
    rows whose code has no rate are returned as rejects instead of failing.
    """
    base = rates_wide.withColumn("_pos", F.col(order_col))
    subs = [c for c in rates_wide.columns if c not in (code_col, order_col)]
    long = base.unpivot([code_col, "_pos"], subs, who_col, "rate")
    first = long.groupBy(code_col, who_col).agg(F.min_by("rate", "_pos").alias("rate"))
    j = work.join(first, (work[work_code] == first[code_col]) & (work[who_col] == first[who_col]), "left") \
        .drop(first[who_col]).drop(code_col)
    return j.filter(F.col("rate").isNotNull()), j.filter(F.col("rate").isNull())


def union_tagged(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Tables of differing columns in one, each row tagged with its table's name (missing columns null)."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

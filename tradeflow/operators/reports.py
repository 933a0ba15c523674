"""Report operators.

Reports are Spark SQL texts with *named parameters* (``spark.sql(text,
args=...)``): values are bound, never substituted into the text. A report
registry maps names to texts; templates with control flow are rejected and
DDL/DML is refused, as the reference's registry rules do.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradeflow.functions.text import check_identifier


def ilike_any_none(c: str | Column, matches: Sequence[str], exceptions: Sequence[str] = ()) -> Column:
    """Column ILIKE any of ``matches`` AND NOT ILIKE each of ``exceptions``."""
    col = F.col(c) if isinstance(c, str) else c
    any_m = F.lit(False)
    for m in matches:
        any_m = any_m | col.ilike(m)
    cond = any_m
    for e in exceptions:
        cond = cond & ~col.ilike(e)
    return cond


VARIATION_MATCHES = ("%vo%", "%variation%")
VARIATION_EXCEPTIONS = ("%avo%", "%vog%")


def variation_quotes(quotes: DataFrame, ref: str = "quote_ref") -> DataFrame:
    """Quotes whose reference looks like a variation order."""
    return quotes.filter(ilike_any_none(ref, VARIATION_MATCHES, VARIATION_EXCEPTIONS))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """O3: top-k (TakeOrderedAndProject: per-partition top k, then merge)."""
    return df.orderBy(*order).limit(k)


def preview(df: DataFrame, *key: str, n: int = 100) -> DataFrame:
    """The first n rows of a table by its key (the preview is the feature)."""
    return df.orderBy(*key).limit(n)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A random sample of n rows: those whose key hashes lowest with the
    seed, so the same rows come back however the table is partitioned."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


# ---------------------------------------------------------------------------
# Report registry
_COMMENT = re.compile(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*", re.S)
_QUERY = re.compile(r"(?:\(\s*)*(?:select|with|from|values|table)\b", re.I)  # a statement that only reads begins so
_WRITES = re.compile(r"\binsert\s+(?:into|overwrite)\b", re.I)  # WITH and FROM may also lead an insert
_CONTROL = re.compile(r"\{%")
_VAR = re.compile(r"\{\{\s*(\w+)\s*\}\}")


@dataclass
class Report:
    name: str
    sql: str
    is_template: bool = False
    variables: list[str] = field(default_factory=list)


def is_query(sql: str) -> bool:
    """True for a text that only reads: after leading comments it begins like a query and inserts nothing."""
    body = sql[_COMMENT.match(sql).end():]
    plain = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'", " ", body, flags=re.S)
    return bool(_QUERY.match(body)) and not _WRITES.search(plain)


def register_report(registry: dict[str, Report], name: str, sql: str) -> Report | None:
    """Add a report; ``{{ var }}`` becomes the named parameter ``:var``.
    anything but a query, and templates with control flow, are skipped (returns None)."""
    check_identifier(name)
    if not is_query(sql) or _CONTROL.search(sql):
        return None
    variables = list(dict.fromkeys(_VAR.findall(sql)))
    text = _VAR.sub(lambda m: f":{m.group(1)}", sql)
    rep = Report(name, text, bool(variables), variables)
    registry[name] = rep
    return rep


def run_report(spark: SparkSession, registry: dict[str, Report], name: str, frames: dict[str, DataFrame] | None = None,
               **params) -> tuple[DataFrame | None, str | None]:
    """Run a report with bound parameters, and tables for the ``{names}`` in
    its text; errors come back as values."""
    try:
        rep = registry[name]
        missing = [v for v in rep.variables if v not in params]
        if missing:
            return None, f"missing parameters: {missing}"
        return spark.sql(rep.sql, args={k: params[k] for k in rep.variables}, **(frames or {})), None
    except Exception as e:  # noqa: BLE001 - reported to the caller
        return None, f"{type(e).__name__}: {e}"


def validate_report(spark: SparkSession, sql: str, **params) -> str | None:
    """R15 dry run: analysis only (no job runs, and commands are refused before
    Spark sees them); returns an error text or None."""
    if not is_query(sql):
        return "not a query"
    try:
        spark.sql(sql, args=params or None).schema  # noqa: B018 - forces analysis
        return None
    except Exception as e:  # noqa: BLE001
        return f"{type(e).__name__}: {e}"


def save_query(saved: DataFrame, name: str, sql: str) -> DataFrame:
    """The saved queries (name, sql) with one added or replaced by name."""
    check_identifier(name)
    if not is_query(sql):
        raise ValueError("not a query")
    row = saved.sparkSession.createDataFrame([(name, sql)], "name string, sql string")
    return saved.select("name", "sql").join(row.select("name"), "name", "left_anti").unionByName(row)


USE_KEYS = ("query_name", "user_email")


def append_uses(batches: DataFrame, path: str) -> None:
    """Adds uses (query_name, user_email, last_used_at, use_id, batch) to the append-only log at ``path``. A batch
    that is sent again replaces itself, so a replay leaves the log as one run would."""
    batches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_uses(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def compact_uses(log: DataFrame, base: DataFrame | None = None, keys: Sequence[str] = USE_KEYS) -> DataFrame:
    """The usage upsert as last write wins: per key the latest (last_used_at, use_id) and the number of uses. Uses
    that the log holds twice count once; ``base``, an earlier compaction, is merged with the uses of later batches."""
    once = log.dropDuplicates([*keys, "last_used_at", "use_id"])
    per = once.select(*keys, F.struct("last_used_at", "use_id").alias("_use"), F.lit(1).cast("long").alias("n_uses"))
    if base is not None:
        per = per.unionByName(base.select(*keys, F.struct("last_used_at", "use_id").alias("_use"), "n_uses"))
    return per.groupBy(*keys).agg(F.max("_use").alias("_use"), F.sum("n_uses").alias("n_uses")).select(*keys, "_use.*", "n_uses")


def last_used(usage_log: DataFrame, keys: Sequence[str] = USE_KEYS, ts: str = "last_used_at") -> DataFrame:
    """R15 usage upsert as a last-write-wins view over an append-only log."""
    return usage_log.groupBy(*keys).agg(F.max(ts).alias(ts))


def queries_by_last_use(queries: DataFrame, usage: DataFrame, name: str = "name", place: str | None = None) -> DataFrame:
    """Saved queries by last use, never-used last; ``place`` names a column for their place in that order."""
    lu = usage.groupBy(F.col("query_name").alias(name)).agg(F.max("last_used_at").alias("last_used_at"))
    order = (F.col("last_used_at").desc_nulls_last(), F.col(name))
    listed = queries.join(lu, name, "left")
    if place:  # a list of saved queries, not of their uses
        return listed.withColumn(place, F.row_number().over(Window.orderBy(*order)))
    return listed.orderBy(*order)


# ---------------------------------------------------------------------------
# The pattern filter over any table and column
FILTER_SQL = """
SELECT * FROM {table}
WHERE exists({{ matches }}, m -> %s ILIKE m) AND NOT coalesce(exists({{ exceptions }}, m -> %s ILIKE m), FALSE)"""


def filter_table(spark: SparkSession, df: DataFrame, column: str, matches: Sequence[str], exceptions: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``column`` is like any of ``matches`` and none of ``exceptions``, as a report with bound lists.
    Only the column's name enters the text, and it is checked. Without matches no row qualifies."""
    check_identifier(column)
    reports: dict[str, Report] = {}
    register_report(reports, "filter_table", FILTER_SQL % (column, column))
    # an empty list is bound as one null, which nothing is like
    bound = {k: F.array(*([F.lit(x) for x in v] or [F.lit(None)])) for k, v in (("matches", matches), ("exceptions", exceptions))}
    out, error = run_report(spark, reports, "filter_table", {"table": df}, **bound)
    if error:
        raise ValueError(error)
    return out

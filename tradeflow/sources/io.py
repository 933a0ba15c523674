"""Table sources and sinks.

Thin, generic wrappers over the DataFrame reader/writer and the catalog.
Writes are idempotent overwrites (re-running a stage after a failure gives
the same table).
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeflow.functions.text import check_identifier, lenient_report_date

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV / Parquet / JSON by file suffix; anything else is an error."""
    fmt = next((f for s, f in FORMATS.items() if path.lower().endswith(s)), None)
    if fmt is None:
        raise ValueError(f"unsupported file type: {path}")
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_csv_filled(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; columns whose header cell is blank are dropped; nulls -> ''.

    The reader gives blank headers made-up names, so the header cells
    themselves decide, by position.
    """
    head = spark.read.option("header", False).csv(path).first()
    df = spark.read.option("header", True).csv(path)
    keep = [c for c, h in zip(df.columns, head or ()) if h is not None and str(h).strip()]
    return df.select(*[F.col(f"`{c}`") for c in keep]).na.fill("")


def read_ledger_report(spark: SparkSession, path: str, skip_rows: int = 4) -> DataFrame:
    """Exported ledger reports — per file, ``skip_rows`` leading rows are
    skipped and the next one is the header; quoted cells may hold commas;
    ``Date`` is ``d MMM yyyy`` (lenient); rows with any null or empty cell are
    dropped. A cell may not span lines. Files may have their columns in any
    order: each is read by its own header, under the first file's order; a file
    with other columns raises an error that names it.

    A file's first rows lie in its first block, where line ids are
    consecutive, so each row knows its place without a sort.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_i"))
    starts = lines.filter(F.col("_block") == 0).groupBy("_file").agg(F.min("_i").alias("_first"))
    numbered = lines.join(starts, "_file").withColumn(
        "_n", F.when(F.col("_block") == 0, F.col("_i") - F.col("_first")))
    heads = numbered.filter(F.col("_n") == skip_rows).select("_file", "value").orderBy("_file")
    per_file = [(r["_file"], [c.strip() for c in next(csv.reader([r["value"]]))]) for r in heads.collect()]  # one row a file
    if not per_file:
        return spark.createDataFrame([], "Date date")
    names = per_file[0][1]
    odd = [f for f, own in per_file if sorted(own) != sorted(names)]
    if odd:
        raise ValueError(f"columns differ from those of {per_file[0][0]}: {odd[:5]}")
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    data = numbered.filter(F.col("_n").isNull() | (F.col("_n") > skip_rows)).filter(F.trim("value") != "")
    orders = spark.createDataFrame(per_file, "_file string, _names array<string>")
    row = data.join(orders, "_file").select("_names", F.from_csv("value", cells, {"escape": '"'}).alias("c")) \
        .select("_names", F.array(*[F.col(f"c.c{i}") for i in range(len(names))]).alias("c"))
    # the k-th of equal names is the k-th place of that name in the file's own header
    place = lambda h, k: F.get(F.filter(F.transform("_names", lambda x, i: F.when(x == h, i)), lambda i: i.isNotNull()), F.lit(k))
    df = row.select(*[F.get("c", place(h, names[:i].count(h))).alias(h) for i, h in enumerate(names)])
    if "Date" in df.columns:
        df = df.withColumn("Date", lenient_report_date("Date"))
    return df.dropna(how="any")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Read a catalog table after the identifier check."""
    return spark.table(check_identifier(name))


def list_tables(spark: SparkSession) -> DataFrame:
    """Catalog tables (and their columns) as DataFrames."""
    rows = [(t.name, t.database, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")


def list_columns(spark: SparkSession, table: str) -> DataFrame:
    rows = [(table, c.name, c.dataType, bool(c.nullable)) for c in spark.catalog.listColumns(check_identifier(table))]
    return spark.createDataFrame(rows, "table string, column string, data_type string, nullable boolean")


def save_table(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet") -> None:
    """K1: create-or-replace a table (catalog table, or files at ``path``)."""
    check_identifier(name)
    w = df.write.mode("overwrite").format(fmt)
    if path:
        w.save(f"{path.rstrip('/')}/{name}")
    else:
        w.saveAsTable(name)


def save_to(df: DataFrame, name: str, destinations: Sequence[str], path: str) -> list[str]:
    """K2: write to files, catalog or both; a failed catalog write falls back
    to files. Returns where the table landed."""
    done = []
    if "catalog" in destinations:
        try:
            save_table(df, name)
            done.append("catalog")
        except AnalysisException:  # the catalog refuses the table; errors of the data itself are raised
            if "files" not in destinations:
                destinations = list(destinations) + ["files"]
    if "files" in destinations:
        save_table(df, name, path=path)
        done.append("files")
    return done


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """K3: export to CSV (with header) or JSON lines."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))


def write_with_rejects(kept: DataFrame, rejected: DataFrame, name: str, path: str) -> None:
    """K4: write a stage and its reject table side by side."""
    save_table(kept, name, path=path)
    save_table(rejected, f"{name}_rejected", path=path)


def status(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """K5: rows per expected table, missing flagged (one count per present table)."""
    parts = []
    for name, df in tables.items():
        if df is None:
            parts.append(spark.createDataFrame([(name, None, True)], "table string, n_rows long, missing boolean"))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"))
                         .select(F.lit(name).alias("table"), "n_rows", F.lit(False).alias("missing")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

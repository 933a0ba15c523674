"""Ragged spreadsheet grids -> typed tables, many sheets in one job.

Input contract (S7): ``(sheet string, row_idx long, cells array<string>)``,
0-based ``row_idx``. All per-sheet logic is either a ``groupBy(sheet)``
aggregate (header detection, widths, profiles) or a window over
``(sheet, row_idx)`` (blank-run segmentation). Header arrays are bounded by
the sheet width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANK_RE = r"^[ \t\r\n]*$"


def _non_blank(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(BLANK_RE)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def grid_from_text(df: DataFrame, *, sheet: str, text: str, row_sep: str = "\n", cell_sep: str = ",") -> DataFrame:
    """S7 helper: a text column -> grid rows (lines) of cells."""
    rows = df.select(F.col(sheet).cast("string").alias("sheet"),
                     F.posexplode(F.split(F.col(text), row_sep)).alias("row_idx", "line"))
    return rows.select("sheet", F.col("row_idx").cast("long").alias("row_idx"),
                       F.split("line", cell_sep).alias("cells"))


def row_stats(grid: DataFrame) -> DataFrame:
    """G11 per row: width and non-empty cell count."""
    return grid.withColumn("width", F.size("cells")) \
        .withColumn("n_filled", F.size(F.filter("cells", _non_blank)))


def first_free(names: Column) -> Column:
    """Names made unique in order: a name that is taken gets ``_1``, ``_2``, ..., the first that is free. The fold
    carries the names taken, which are the result."""
    def add(taken: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: F.concat(name, F.lit("_"), k.cast("string")))
        free = F.get(F.filter(tries, lambda x: ~F.array_contains(taken, x)), F.lit(0))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, name), free).otherwise(name)))
    return F.aggregate(names, F.array().cast("array<string>"), add)


def detect_headers(grid: DataFrame, *, scan_rows: int = 5, fixed_row: int | None = None) -> DataFrame:
    """G1 + G2 + G3: per sheet the header row and cleaned, widened, de-duplicated names.

    Header row: within the first ``scan_rows`` rows the one with most
    non-empty cells, ties -> earliest; ``fixed_row`` (1-based) overrides it
    and yields no header when beyond the data. Names: blank -> ``column_{i}``
    (0-based), else stripped; widened to the widest row of the sheet; a
    repeated name gets the first free ``_k``.
    """
    st = row_stats(grid)
    widest = st.groupBy("sheet").agg(F.max("width").alias("n_cols"))
    if fixed_row is None:
        cand = st.filter(F.col("row_idx") < scan_rows)
        hdr = cand.groupBy("sheet").agg(
            F.max_by("row_idx", F.struct(F.col("n_filled"), -F.col("row_idx"))).alias("header_row"))
    else:
        hdr = st.filter(F.col("row_idx") == fixed_row - 1).select("sheet", F.col("row_idx").alias("header_row"))
    h = hdr.join(st.select("sheet", F.col("row_idx").alias("header_row"), "cells"), ["sheet", "header_row"]) \
        .join(widest, "sheet")
    idx = F.when(F.col("n_cols") > 0, F.sequence(F.lit(0), F.col("n_cols") - 1)) \
        .otherwise(F.array().cast("array<int>"))  # a sheet without any cell has no columns
    raw = F.transform(idx, lambda i: F.when(_non_blank(F.get(F.col("cells"), i)), _strip(F.get(F.col("cells"), i)))
                      .otherwise(F.concat(F.lit("column_"), i.cast("string"))))
    named = h.withColumn("_raw", raw)
    return named.select("sheet", "header_row", "n_cols", first_free(F.col("_raw")).alias("headers"))


def to_schema(rows: DataFrame, headers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """G5 with a given schema: one column per name of ``columns``, filled by position as the sheet has them; rows are
    padded with null or cut to it, whatever width their sheet has. ``rows`` (sheet, row_idx, values)."""
    own = rows.join(headers.select("sheet"), "sheet", "left_semi")
    return own.select("sheet", "row_idx", *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(columns)])


def normalise_rows(grid: DataFrame, headers: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """G4 + G5: data rows after the header, padded with null / truncated to the
    header width, ``''`` -> null. ``strict`` rejects rows whose width differs."""
    j = grid.join(headers.select("sheet", "header_row", "n_cols"), "sheet").filter(F.col("row_idx") > F.col("header_row"))
    padded = F.slice(F.concat(F.col("cells"), F.array_repeat(F.lit(None).cast("string"), F.col("n_cols"))), 1,
                     F.col("n_cols"))
    clean = F.transform(padded, lambda c: F.when(c == "", F.lit(None)).otherwise(c))
    rows = j.withColumn("values", clean)
    if strict:
        ok = F.size("cells") == F.col("n_cols")
        return rows.filter(ok).select("sheet", "row_idx", "values"), \
            rows.filter(~ok).select("sheet", "row_idx", F.size("cells").alias("width"), "n_cols")
    return rows.select("sheet", "row_idx", "values"), rows.limit(0).select("sheet", "row_idx")


def segment_tables(grid: DataFrame, *, max_blank_rows: int = 3) -> DataFrame:
    """Runs of >= ``max_blank_rows`` blank rows end a table; shorter blank
    runs stay inside. Per (sheet, table_no): first row, last non-blank row,
    row span and non-blank row count (gaps-and-islands with windows)."""
    st = row_stats(grid).withColumn("blank", F.col("n_filled") == 0)
    w = Window.partitionBy("sheet").orderBy("row_idx")
    st = st.withColumn("_chg", (F.col("blank") != F.lag("blank").over(w)).cast("int"))
    st = st.withColumn("_run", F.sum(F.coalesce("_chg", F.lit(0))).over(w))
    runs = st.groupBy("sheet", "_run").agg(F.count(F.lit(1)).alias("_len"), F.first("blank").alias("_blank"))
    st = st.join(runs, ["sheet", "_run"])
    st = st.withColumn("_sep", (F.col("_blank") & (F.col("_len") >= max_blank_rows)).cast("int"))
    # table number = separator runs seen before this row's run (count once per run)
    st = st.withColumn("_sep_start", F.when((F.col("_sep") == 1) & (F.coalesce(F.col("_chg"), F.lit(1)) == 1), 1)
                       .otherwise(0))
    st = st.withColumn("table_no", F.sum("_sep_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    data = st.filter(F.col("_sep") == 0)
    return data.groupBy("sheet", "table_no").agg(
        F.min("row_idx").alias("start_row"),
        F.max(F.when(~F.col("blank"), F.col("row_idx"))).alias("end_row"),
        F.count(F.when(~F.col("blank"), 1)).alias("n_rows"))


def table_rows(grid: DataFrame, *, max_blank_rows: int = 3) -> DataFrame:
    """G6 per table: the first non-blank row of each segment is its header
    (cleaned and de-duplicated as in G3, over the table's own width), the other
    non-blank rows are its data: (sheet, table_no, row_idx, headers, values)."""
    tables = segment_tables(grid, max_blank_rows=max_blank_rows).filter(F.col("n_rows") > 0)
    inside = (row_stats(grid).filter(F.col("n_filled") > 0).alias("g")
              .join(tables.alias("t"), (F.col("g.sheet") == F.col("t.sheet"))
                    & F.col("g.row_idx").between(F.col("t.start_row"), F.col("t.end_row")))
              .select("g.*", "t.table_no"))
    key = F.concat_ws("\x1f", "sheet", F.col("table_no").cast("string"))
    own = inside.select("sheet", "table_no", key.alias("_key"), "row_idx", "cells")
    heads = own.groupBy("_key").agg(F.min("row_idx").alias("_first"))
    named = detect_headers(own.join(heads, "_key").select(F.col("_key").alias("sheet"), "cells",
                                                          (F.col("row_idx") - F.col("_first")).alias("row_idx")),
                           scan_rows=1).withColumnRenamed("sheet", "_key")
    rows = own.join(heads, "_key").filter(F.col("row_idx") > F.col("_first")).join(named, "_key")
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.col("n_cols"))), 1, F.col("n_cols"))
    return rows.select("sheet", "table_no", "row_idx", "headers",
                       F.transform(padded, lambda c: F.when(c != "", c)).alias("values"))


def detect_ranges(grid: DataFrame, *, keep_last_row: bool = True) -> DataFrame:
    """A row belongs to a table iff it and the next row are non-empty
    (``keep_last_row`` also keeps a table's final row, fixing Q17); tables
    need >= 1 data row. Emits start, end (0-based) per table."""
    st = row_stats(grid).withColumn("filled", F.col("n_filled") > 0)
    w = Window.partitionBy("sheet").orderBy("row_idx")
    nxt = F.coalesce(F.lead("filled").over(w), F.lit(False))
    prv = F.coalesce(F.lag("filled").over(w), F.lit(False))
    member = (F.col("filled") & nxt) | (F.col("filled") & prv) if keep_last_row else (F.col("filled") & nxt)
    st = st.withColumn("_m", member)
    st = st.withColumn("_start", (F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False))).cast("int"))
    st = st.withColumn("_tab", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (st.filter("_m").groupBy("sheet", "_tab")
            .agg(F.min("row_idx").alias("start_row"), F.max("row_idx").alias("end_row"))
            .filter(F.col("end_row") > F.col("start_row"))
            .withColumnRenamed("_tab", "table_no"))


def column_letters(n: Column) -> Column:
    """The letters of the n-th column (from 1): A to Z, AA to ZZ, AAA to ZZZ; null beyond."""
    letter = lambda x: F.char(F.lit(65) + x.cast("int"))
    two, three = n - 27, n - 703
    at = lambda x, unit: F.pmod(F.floor(x / unit), F.lit(26))
    return (F.when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(at(two, 26)), letter(at(two, 1))))
            .when(n <= 18_278, F.concat(letter(at(three, 676)), letter(at(three, 26)), letter(at(three, 1)))))


def a1_ranges(grid: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges of :func:`detect_ranges` in A1 notation, from column A to the width of the table's header row."""
    heads = grid.select("sheet", F.col("row_idx").alias("start_row"), F.size("cells").alias("n_cols"))
    j = ranges.join(heads, ["sheet", "start_row"])
    first, last = (F.col("start_row") + 1).cast("string"), (F.col("end_row") + 1).cast("string")
    return j.select("sheet", "table_no", "start_row", "end_row", "n_cols", F.concat(
        F.col("sheet"), F.lit("!A"), first, F.lit(":"), column_letters(F.col("n_cols")), last).alias("range"))


def truncation_suspect(n_rows: Column, page: int = 1000) -> Column:
    """``n > 0 and (n mod page < 10 or n mod page > page - 10)`` (Q14 parity)."""
    m = F.pmod(n_rows, F.lit(page))
    return (n_rows > 0) & ((m < 10) | (m > page - 10))


def expectations(tables: DataFrame, *, min_rows: int = 1, page: int = 1000, headers: DataFrame | None = None,
                 required: Sequence[str] = (), min_tables: int | None = None) -> DataFrame:
    """Expectation rows (sheet, table_no, check, severity, passed, observed): enough rows and no sign of a page limit
    per table; with ``headers`` (sheet, table_no, headers) the ``required`` names among each table's (observed: how
    many are missing); with ``min_tables`` enough tables per sheet (table_no null)."""
    per = tables.select("sheet", "table_no", "n_rows")
    row = lambda df, name, severity, passed, observed: df.select(
        "sheet", F.col("table_no").cast("long").alias("table_no"), F.lit(name).alias("check"), F.lit(severity).alias("severity"),
        passed.alias("passed"), observed.cast("double").alias("observed"))
    n = F.col("n_rows")
    out = row(per, "min_rows", "warning", n >= min_rows, n).unionByName(row(per, "truncation", "error", ~truncation_suspect(n, page), n))
    if headers is not None and required:
        missing = F.size(F.array_except(F.array(*[F.lit(x) for x in required]), F.coalesce("headers", F.array().cast("array<string>"))))
        named = per.join(headers.select("sheet", "table_no", "headers"), ["sheet", "table_no"], "left").withColumn("missing", missing)
        out = out.unionByName(row(named, "required_columns", "error", F.col("missing") == 0, F.col("missing")))
    if min_tables is not None:
        count = per.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.lit(None).alias("table_no"))
        out = out.unionByName(row(count, "min_tables", "warning", F.col("n") >= min_tables, F.col("n")))
    return out


def sheet_profile(grid: DataFrame) -> DataFrame:
    """G11 + G10 summary: per sheet rows, widest row, filled cells, blank rows."""
    st = row_stats(grid)
    return st.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"), F.max("width").alias("max_width"),
                                   F.sum("n_filled").alias("n_filled_cells"),
                                   F.count(F.when(F.col("n_filled") == 0, 1)).alias("n_blank_rows"))


def sheet_overview(grid: DataFrame, *, first_cells: int = 5) -> DataFrame:
    """G11 for people: the profile, the first cells of the first row, and the detected headers."""
    first = grid.filter(F.col("row_idx") == 0).select("sheet", F.slice("cells", 1, first_cells).alias("first_cells"))
    heads = detect_headers(grid).select("sheet", "header_row", "headers")
    return sheet_profile(grid).join(first, "sheet", "left").join(heads, "sheet", "left")

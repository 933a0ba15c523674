"""Grid parsing queries: every document is a sheet, lines are rows, commas split cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.plans.fixtures import tables
from tradeflow.plans.registry import register
from tradeflow.sources import grid as G

DUCK_GRID = r"""
WITH rows AS (
  SELECT CAST(doc_id AS VARCHAR) AS sheet, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS row_idx,
         unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
g AS (
  SELECT sheet, row_idx, string_split(line, ',') AS cells FROM rows),
st AS (
  SELECT sheet, row_idx, cells, len(cells) AS width,
         len(list_filter(cells, lambda c: c IS NOT NULL AND NOT regexp_matches(c, '^[ \t\r\n]*$'))) AS n_filled
  FROM g)
"""


#: names ``r`` made unique in order: the first free suffix
_FIRST_FREE = """list_reduce(list_transform(r, lambda x: [x]), lambda t, x: list_concat(t, [CASE WHEN NOT list_contains(t, x[1]) THEN x[1]
         ELSE list_filter(list_transform(range(1, len(t) + 2), lambda k: x[1] || '_' || CAST(k AS VARCHAR)),
                          lambda y: NOT list_contains(t, y))[1] END]), CAST([] AS VARCHAR[]))"""


def grid(spark, sf_dir):
    return G.grid_from_text(tables(spark, sf_dir)["documents"], sheet="doc_id", text="text")


@register("grid_profile", "G11,S7", bench=True, oracle=lambda: DUCK_GRID + """
SELECT sheet, count(*) AS n_rows, max(width) AS max_width, sum(n_filled) AS n_filled_cells,
       count(*) FILTER (WHERE n_filled = 0) AS n_blank_rows
FROM st GROUP BY sheet""")
def grid_profile(spark, sf_dir):
    return G.sheet_profile(grid(spark, sf_dir))


@register("grid_headers", "G1,G2,G3", oracle=lambda: DUCK_GRID + r""",
w AS (SELECT sheet, max(width) AS n_cols FROM st GROUP BY sheet),
h AS (SELECT sheet, arg_max(row_idx, n_filled * 1000 - row_idx) AS header_row FROM st WHERE row_idx < 5 GROUP BY sheet),
raw AS (
  SELECT h.sheet, h.header_row, w.n_cols,
         list_transform(range(w.n_cols), lambda i:
           CASE WHEN s.cells[i + 1] IS NOT NULL AND NOT regexp_matches(s.cells[i + 1], '^[ \t\r\n]*$')
                THEN regexp_replace(s.cells[i + 1], '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')
                ELSE 'column_' || CAST(i AS VARCHAR) END) AS r
  FROM h JOIN w ON w.sheet = h.sheet JOIN st s ON s.sheet = h.sheet AND s.row_idx = h.header_row)
SELECT sheet, header_row, n_cols,
       """ + _FIRST_FREE + r""" AS headers
FROM raw""")
def grid_headers(spark, sf_dir):
    return G.detect_headers(grid(spark, sf_dir))


@register("grid_tables", "G6,G8", oracle=lambda: DUCK_GRID + """,
b AS (SELECT *, n_filled = 0 AS blank,
             CASE WHEN (n_filled = 0) <> lag(n_filled = 0) OVER (PARTITION BY sheet ORDER BY row_idx) THEN 1
                  ELSE 0 END AS chg
      FROM st),
r AS (SELECT *, sum(chg) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS run FROM b),
rl AS (SELECT *, count(*) OVER (PARTITION BY sheet, run) AS len FROM r),
sp AS (SELECT *, CASE WHEN blank AND len >= 3 THEN 1 ELSE 0 END AS sep,
              CASE WHEN blank AND len >= 3 AND (chg = 1 OR row_idx = min(row_idx) OVER (PARTITION BY sheet))
                   THEN 1 ELSE 0 END AS sep_start
       FROM rl),
t AS (SELECT *, sum(sep_start) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS table_no FROM sp)
SELECT sheet, table_no, min(row_idx) AS start_row, max(CASE WHEN NOT blank THEN row_idx END) AS end_row,
       count(*) FILTER (WHERE NOT blank) AS n_rows,
       count(*) FILTER (WHERE NOT blank) > 0 AND (count(*) FILTER (WHERE NOT blank) % 1000 < 10
                                                  OR count(*) FILTER (WHERE NOT blank) % 1000 > 990) AS truncation_suspect
FROM t WHERE sep = 0 GROUP BY sheet, table_no""")
def grid_tables(spark, sf_dir):
    t = G.segment_tables(grid(spark, sf_dir))
    return t.withColumn("truncation_suspect", G.truncation_suspect(F.col("n_rows")))


@register("grid_ranges", "G7", oracle=lambda: DUCK_GRID + """,
f AS (SELECT sheet, row_idx, n_filled > 0 AS filled FROM st),
m AS (SELECT *, (filled AND coalesce(lead(filled) OVER (PARTITION BY sheet ORDER BY row_idx), FALSE))
                OR (filled AND coalesce(lag(filled) OVER (PARTITION BY sheet ORDER BY row_idx), FALSE)) AS mem
      FROM f),
s AS (SELECT *, CASE WHEN mem AND NOT coalesce(lag(mem) OVER (PARTITION BY sheet ORDER BY row_idx), FALSE) THEN 1
                     ELSE 0 END AS st_flag FROM m),
t AS (SELECT *, sum(st_flag) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS table_no FROM s)
SELECT sheet, table_no, min(row_idx) AS start_row, max(row_idx) AS end_row FROM t WHERE mem
GROUP BY sheet, table_no HAVING max(row_idx) > min(row_idx)""")
def grid_ranges(spark, sf_dir):
    return G.detect_ranges(grid(spark, sf_dir)).select("sheet", "table_no", "start_row", "end_row")


_ROWS = r""",
w AS (SELECT sheet, max(width) AS n_cols FROM st GROUP BY sheet),
h AS (SELECT sheet, arg_max(row_idx, n_filled * 1000 - row_idx) AS header_row FROM st WHERE row_idx < 5 GROUP BY sheet)"""


@register("grid_rows", "G4", oracle=lambda: DUCK_GRID + _ROWS + """
SELECT s.sheet, s.row_idx, list_transform(range(w.n_cols), lambda i: nullif(s.cells[i + 1], '')) AS "values"
FROM st s JOIN h ON h.sheet = s.sheet JOIN w ON w.sheet = s.sheet WHERE s.row_idx > h.header_row""")
def grid_rows(spark, sf_dir):
    g = grid(spark, sf_dir)
    return G.normalise_rows(g, G.detect_headers(g))[0]


@register("grid_rows_rejected", "G5", oracle=lambda: DUCK_GRID + _ROWS + """
SELECT s.sheet, s.row_idx, s.width, w.n_cols
FROM st s JOIN h ON h.sheet = s.sheet JOIN w ON w.sheet = s.sheet
WHERE s.row_idx > h.header_row AND s.width <> w.n_cols""")
def grid_rows_rejected(spark, sf_dir):
    """Strict mode: rows whose width is not the sheet's."""
    g = grid(spark, sf_dir)
    return G.normalise_rows(g, G.detect_headers(g), strict=True)[1]


#: each document with a second table after three blank rows, with repeated headers of which one takes another's next name
_TWO_TABLES = "text || chr(10) || chr(10) || chr(10) || chr(10) || 'k,k,k_1,' || chr(10) || source || ',' || lang || ',,1'"


@register("grid_table_rows", "G6,G3", oracle=lambda: DUCK_GRID.replace(
    "string_split(text, chr(10))", f"string_split({_TWO_TABLES}, chr(10))") + r""",
b AS (SELECT *, n_filled = 0 AS blank,
             CASE WHEN (n_filled = 0) <> lag(n_filled = 0) OVER (PARTITION BY sheet ORDER BY row_idx) THEN 1
                  ELSE 0 END AS chg FROM st),
r AS (SELECT *, sum(chg) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS run FROM b),
rl AS (SELECT *, count(*) OVER (PARTITION BY sheet, run) AS len FROM r),
sp AS (SELECT *, CASE WHEN blank AND len >= 3 AND (chg = 1 OR row_idx = min(row_idx) OVER (PARTITION BY sheet))
                   THEN 1 ELSE 0 END AS sep_start FROM rl),
t AS (SELECT *, sum(sep_start) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS table_no FROM sp),
d AS (SELECT *, min(row_idx) OVER (PARTITION BY sheet, table_no) AS first_row,
             max(width) OVER (PARTITION BY sheet, table_no) AS n_cols FROM t WHERE NOT blank),
raw AS (SELECT sheet, table_no, list_transform(range(n_cols), lambda i:
           CASE WHEN cells[i + 1] IS NOT NULL AND NOT regexp_matches(cells[i + 1], '^[ 	
]*$')
                THEN regexp_replace(cells[i + 1], '^[ 	
]+|[ 	
]+$', '', 'g')
                ELSE 'column_' || CAST(i AS VARCHAR) END) AS r FROM d WHERE row_idx = first_row),
hd AS (SELECT sheet, table_no, """ + _FIRST_FREE + r""" AS headers FROM raw)
SELECT d.sheet, d.table_no, d.row_idx, hd.headers,
       list_transform(range(d.n_cols), lambda i: nullif(d.cells[i + 1], '')) AS "values"
FROM d JOIN hd ON hd.sheet = d.sheet AND hd.table_no = d.table_no WHERE d.row_idx > d.first_row""")
def grid_table_rows(spark, sf_dir):
    """Headers and rows of every sub-table of a sheet."""
    docs = tables(spark, sf_dir)["documents"].select("doc_id", F.expr(_TWO_TABLES).alias("text"))
    return G.table_rows(G.grid_from_text(docs, sheet="doc_id", text="text"))


@register("grid_expectations", "G9", oracle=lambda: DUCK_GRID + """,
n AS (SELECT sheet, count(*) FILTER (WHERE n_filled > 0) AS n_rows FROM st GROUP BY sheet)
SELECT sheet, 0 AS table_no, c AS "check", s AS severity, p AS passed, CAST(n_rows AS DOUBLE) AS observed
FROM n, LATERAL (VALUES ('min_rows', 'warning', n_rows >= 1),
                        ('truncation', 'error', NOT (n_rows > 0 AND (n_rows % 1000 < 10 OR n_rows % 1000 > 990)))) v(c, s, p)""")
def grid_expectations(spark, sf_dir):
    """Checks of each sheet as one table: enough rows, no sign of a page limit."""
    t = G.row_stats(grid(spark, sf_dir)).groupBy("sheet").agg(F.count(F.when(F.col("n_filled") > 0, 1)).alias("n_rows"))
    return G.expectations(t.withColumn("table_no", F.lit(0)))


@register("grid_a1_ranges", "G7", oracle=lambda: DUCK_GRID + """,
f AS (SELECT sheet, row_idx, width, n_filled > 0 AS filled FROM st),
m AS (SELECT *, (filled AND coalesce(lead(filled) OVER (PARTITION BY sheet ORDER BY row_idx), FALSE))
                OR (filled AND coalesce(lag(filled) OVER (PARTITION BY sheet ORDER BY row_idx), FALSE)) AS mem
      FROM f),
s AS (SELECT *, CASE WHEN mem AND NOT coalesce(lag(mem) OVER (PARTITION BY sheet ORDER BY row_idx), FALSE) THEN 1
                     ELSE 0 END AS st_flag FROM m),
t AS (SELECT *, sum(st_flag) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS table_no FROM s),
r AS (SELECT sheet, table_no, min(row_idx) AS start_row, max(row_idx) AS end_row, arg_min(width, row_idx) AS n_cols
      FROM t WHERE mem GROUP BY sheet, table_no HAVING max(row_idx) > min(row_idx))
SELECT *, sheet || '!A' || CAST(start_row + 1 AS VARCHAR) || ':' || CASE WHEN n_cols > 26 THEN chr(64 + CAST((n_cols - 1) // 26 AS INTEGER)) ELSE '' END
       || chr(65 + CAST((n_cols - 1) % 26 AS INTEGER)) || CAST(end_row + 1 AS VARCHAR) AS "range" FROM r""")
def grid_a1_ranges(spark, sf_dir):
    """Detected tables as A1 ranges."""
    g = grid(spark, sf_dir)
    return G.a1_ranges(g, G.detect_ranges(g))


_FIXED = ("a", "b", "c", "d")


@register("grid_rows_fixed", "G5", oracle=lambda: DUCK_GRID + _ROWS + ", n AS (SELECT s.*, w.n_cols FROM st s JOIN h ON h.sheet = s.sheet "
          "JOIN w ON w.sheet = s.sheet WHERE s.row_idx > h.header_row) SELECT sheet, row_idx, " + ", ".join(
              f"CASE WHEN n_cols > {i} THEN nullif(cells[{i + 1}], '') END AS {c}" for i, c in enumerate(_FIXED)) + " FROM n")
def grid_rows_fixed(spark, sf_dir):
    """The rows of every sheet padded or cut to one given schema."""
    g = grid(spark, sf_dir)
    heads = G.detect_headers(g)
    return G.to_schema(G.normalise_rows(g, heads)[0], heads, _FIXED)


@register("grid_overview", "G11", oracle=lambda: DUCK_GRID + r""",
w AS (SELECT sheet, count(*) AS n_rows, max(width) AS max_width, sum(n_filled) AS n_filled_cells, count(*) FILTER (WHERE n_filled = 0) AS n_blank_rows
      FROM st GROUP BY sheet),
h AS (SELECT sheet, arg_max(row_idx, n_filled * 1000 - row_idx) AS header_row FROM st WHERE row_idx < 5 GROUP BY sheet),
raw AS (SELECT h.sheet, h.header_row, list_transform(range(w.max_width), lambda i:
           CASE WHEN s.cells[i + 1] IS NOT NULL AND NOT regexp_matches(s.cells[i + 1], '^[ \t\r\n]*$')
                THEN regexp_replace(s.cells[i + 1], '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')
                ELSE 'column_' || CAST(i AS VARCHAR) END) AS r
        FROM h JOIN w ON w.sheet = h.sheet JOIN st s ON s.sheet = h.sheet AND s.row_idx = h.header_row)
SELECT w.*, st.cells[1:5] AS first_cells, raw.header_row,
       """ + _FIRST_FREE + """ AS headers
FROM w JOIN raw USING (sheet) JOIN st ON st.sheet = w.sheet AND st.row_idx = 0""")
def grid_overview(spark, sf_dir):
    """Profile, first cells and detected headers of every sheet."""
    return G.sheet_overview(grid(spark, sf_dir))


@register("grid_table_expectations", "G9", oracle=lambda: DUCK_GRID.replace(
    "string_split(text, chr(10))", f"string_split({_TWO_TABLES}, chr(10))") + r""",
b AS (SELECT *, n_filled = 0 AS blank,
             CASE WHEN (n_filled = 0) <> lag(n_filled = 0) OVER (PARTITION BY sheet ORDER BY row_idx) THEN 1
                  ELSE 0 END AS chg FROM st),
r AS (SELECT *, sum(chg) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS run FROM b),
rl AS (SELECT *, count(*) OVER (PARTITION BY sheet, run) AS len FROM r),
sp AS (SELECT *, CASE WHEN blank AND len >= 3 AND (chg = 1 OR row_idx = min(row_idx) OVER (PARTITION BY sheet))
                   THEN 1 ELSE 0 END AS sep_start FROM rl),
t AS (SELECT *, sum(sep_start) OVER (PARTITION BY sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS table_no FROM sp),
n AS (SELECT sheet, CAST(table_no AS BIGINT) AS table_no, count(*) AS n_rows, bool_or(line = 'k,k,k_1,') AS own FROM (
        SELECT t.*, array_to_string(cells, ',') AS line FROM t WHERE NOT blank) GROUP BY sheet, table_no)
SELECT sheet, table_no, c AS "check", s AS severity, p AS passed, CAST(o AS DOUBLE) AS observed
FROM n, LATERAL (VALUES ('min_rows', 'warning', n_rows >= 2, n_rows),
                        ('truncation', 'error', NOT (n_rows % 1000 < 10 OR n_rows % 1000 > 990), n_rows),
                        ('required_columns', 'error', own AND n_rows > 1, CASE WHEN own AND n_rows > 1 THEN 0 ELSE 2 END)) v(c, s, p, o)
UNION ALL SELECT sheet, NULL, 'min_tables', 'warning', count(*) >= 2, count(*) FROM n GROUP BY sheet""")
def grid_table_expectations(spark, sf_dir):
    """G9 over sheets of several tables: enough rows and tables, no page limit, and the names that only second tables have."""
    docs = tables(spark, sf_dir)["documents"].select("doc_id", F.expr(_TWO_TABLES).alias("text"))
    g = G.grid_from_text(docs, sheet="doc_id", text="text")
    found = G.segment_tables(g).filter("n_rows > 0")
    return G.expectations(found, min_rows=2, headers=G.table_rows(g).select("sheet", "table_no", "headers").distinct(),
                          required=["k_1", "k_1_1"], min_tables=2)

"""Remaining operator queries: table reads (S8, S11, R12), typing (T7), rehydration
(J11), attached rows (J12), rate lookup (J13), price book (M11-M13), parser
choice (G10), sampling / preview (O5, O6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions.text import batch_cast
from tradeflow.operators import finance, joins
from tradeflow.operators import reports as R
from tradeflow.plans import project_flow as PF
from tradeflow.plans.duck_flow import ctes
from tradeflow.plans.fixtures import table_rows, tables
from tradeflow.plans.q_projects import CALCS_SQL, SALES_SQL, _budget_inputs
from tradeflow.plans.q_grid import DUCK_GRID as _DUCK_GRID
from tradeflow.plans.registry import register
from tradeflow.session import TASK_ROWS, lookup, scratch_path, written
from tradeflow.sources import grid as G, io
from tradeflow.sources.parsers import default_parsers
from tradeflow.streaming import labour_feed as feed


@register("orders_by_suffix", "S8", oracle=lambda: "SELECT * FROM orders")
def orders_by_suffix(spark, sf_dir):
    """Full-table fetch through the suffix-dispatching reader."""
    return io.read_by_suffix(spark, f"{sf_dir}/orders.parquet")


@register("part_batch_cast", "T7", oracle=lambda: """
SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS p_size, TRY_CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice,
       TRY_CAST(p_brand AS INTEGER) AS p_brand FROM part""")
def part_batch_cast(spark, sf_dir):
    p = tables(spark, sf_dir)["part"].select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return batch_cast(p, {"p_size": "double", "p_retailprice": "bigint", "p_brand": "int", "missing": "int"})


@register("orders_rehydrated_strict", "J11", oracle=lambda: """
WITH m AS (SELECT l_partkey AS grp, CASE WHEN l_linenumber = 7 THEN -l_orderkey - 1 ELSE l_orderkey END AS okey
           FROM lineitem),
bad AS (SELECT DISTINCT grp FROM m WHERE okey NOT IN (SELECT o_orderkey FROM orders))
SELECT m.grp, m.okey, o.o_totalprice FROM m JOIN orders o ON o.o_orderkey = m.okey
WHERE m.grp NOT IN (SELECT grp FROM bad)""")
def orders_rehydrated_strict(spark, sf_dir):
    """Groups (parts) whose member list has any unknown order lose all members (parity mode)."""
    t = tables(spark, sf_dir)
    members = t["lineitem"].select(F.col("l_partkey").alias("grp"), F.when(F.col("l_linenumber") == 7,
                                   -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("okey"))
    kept, _ = joins.rehydrate(members, t["orders"].select("o_orderkey", "o_totalprice"), member_key="okey",
                              entity_key="o_orderkey", group="grp", strict=True)
    return kept.select("grp", "okey", "o_totalprice")


@register("item_buildup_rows", "J12", oracle=lambda: (
    "WITH s AS (" + SALES_SQL.format(part="part") + "), c AS (" + CALCS_SQL.format(lineitem="lineitem") + ")\n"
    "SELECT s.code, c.cost_type, c.amount, c.total FROM s LEFT JOIN c ON s.code = c.xero_code"))
def item_buildup_rows(spark, sf_dir):
    sales, calcs = _budget_inputs(spark, sf_dir)
    return joins.attach_rows(sales, calcs, entity_key="code", row_key="xero_code") \
        .select("code", "cost_type", "amount", "total")


@register("line_rates", "J13", oracle=lambda: """
WITH w AS (SELECT p_type AS lookup_code, p_partkey, p_retailprice AS sub_a, p_retailprice * 2 AS sub_b FROM part),
firsts AS (SELECT lookup_code, arg_min(sub_a, p_partkey) AS sub_a, arg_min(sub_b, p_partkey) AS sub_b
           FROM w GROUP BY lookup_code),
work AS (SELECT l.l_orderkey, l.l_linenumber, p.p_type AS code,
                CASE WHEN l.l_returnflag = 'R' THEN 'sub_a' ELSE 'sub_b' END AS sub
         FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT work.l_orderkey, work.l_linenumber, work.code, work.sub,
       CASE WHEN work.sub = 'sub_a' THEN f.sub_a ELSE f.sub_b END AS rate
FROM work JOIN firsts f ON f.lookup_code = work.code""")
def line_rates(spark, sf_dir):
    t = tables(spark, sf_dir)
    wide = t["part"].select(F.col("p_type").alias("lookup_code"), "p_partkey",
                            F.col("p_retailprice").alias("sub_a"), (F.col("p_retailprice") * 2).alias("sub_b"))
    work = (t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
            .select("l_orderkey", "l_linenumber", F.col("p_type").alias("code"),
                    F.when(F.col("l_returnflag") == "R", "sub_a").otherwise("sub_b").alias("sub")))
    kept, _ = joins.rate_lookup(wide, work, code_col="lookup_code", work_code="code", who_col="sub",
                                order_col="p_partkey")
    return kept.select("l_orderkey", "l_linenumber", "code", "sub", "rate")


@register("price_book_costs", "M11,M12", oracle=lambda: (
    "WITH c AS (" + CALCS_SQL.format(lineitem="lineitem") + "),\n"
    """s AS (SELECT * FROM c WHERE xero_code NOT IN (SELECT 'P' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 50)
      UNION ALL
      SELECT 'P' || CAST(p_partkey AS VARCHAR), 'Labour', CAST(NULL AS DOUBLE), 100.0 FROM part WHERE p_size = 50)
SELECT xero_code, cost_type, coalesce(amount, 0) * 50 + coalesce(total, 0) AS cost FROM s"""))
def price_book_costs(spark, sf_dir):
    """M12 overwrite-by-key of one build-up (size-50 parts get a new single row),
    then M11 null-as-zero cost per row."""
    _, calcs = _budget_inputs(spark, sf_dir)
    p = tables(spark, sf_dir)["part"]
    new = p.filter(F.col("p_size") == 50).select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("xero_code"), F.lit("Labour").alias("cost_type"),
        F.lit(None).cast("double").alias("amount"), F.lit(100.0).alias("total"))
    merged = finance.replace_rows_for_key(calcs, new, "xero_code")
    return merged.select("xero_code", "cost_type",
                         finance.price_book_cost(hours="amount", material="total").alias("cost"))


@register("item_margin_lines", "M13", oracle=lambda: (
    "WITH s AS (" + SALES_SQL.format(part="part") + "), c AS (" + CALCS_SQL.format(lineitem="lineitem") + "),\n"
    """agg AS (SELECT xero_code, sum(CASE WHEN cost_type = 'Labour' THEN amount ELSE 0 END) * 50
                  + sum(CASE WHEN cost_type = 'Supplier' THEN total ELSE 0 END) AS cost FROM c GROUP BY xero_code),
j AS (SELECT s.code, s.sale_price - a.cost AS margin, (s.sale_price - a.cost) / nullif(s.sale_price, 0) AS pct
      FROM s LEFT JOIN agg a ON s.code = a.xero_code)
SELECT code, code || ': margin $' || CAST(CAST(coalesce(margin, 0) AS DECIMAL(18, 2)) AS VARCHAR) || ' ('
       || CAST(CAST(round_even(coalesce(pct, 0) * 100, 0) AS BIGINT) AS VARCHAR) || '%)' AS summary FROM j"""))
def item_margin_lines(spark, sf_dir):
    """M13 summary text per item."""
    sales, calcs = _budget_inputs(spark, sf_dir)
    return finance.item_budget(sales, calcs).select("code", finance.margin_summary().alias("summary"))


_PARSERS = """
cfg AS (SELECT CAST(doc_id AS VARCHAR) AS sheet, CASE lang WHEN 'en' THEN 'standard' WHEN 'fr' THEN 'offset'
               WHEN 'de' THEN 'multi' ELSE 'paginated' END AS parser FROM documents),
hdr AS (SELECT sheet, arg_max(row_idx, n_filled * 1000 - row_idx) AS h FROM st WHERE row_idx < 5 GROUP BY sheet),
std AS (SELECT s.sheet, count(*) AS n FROM st s JOIN hdr ON hdr.sheet = s.sheet AND s.row_idx > hdr.h GROUP BY s.sheet),
off AS (SELECT sheet, count(*) FILTER (WHERE row_idx > 1) AS n FROM st GROUP BY sheet HAVING max(row_idx) >= 1),
multi AS (SELECT sheet, count(*) FILTER (WHERE n_filled > 0) AS n FROM st GROUP BY sheet)"""


@register("parser_choice", "G10", oracle=lambda: _DUCK_GRID + "," + _PARSERS + """
SELECT sheet, parser, n_rows, CASE WHEN n_rows > 0 THEN 'ok' ELSE 'failed' END AS status,
       parser = 'paginated' AND n_rows > 0 AND (n_rows % 1000 < 10 OR n_rows % 1000 > 990) AS truncation_suspect
FROM (SELECT cfg.sheet, parser, coalesce(CASE parser WHEN 'offset' THEN off.n WHEN 'multi' THEN multi.n ELSE std.n END, 0)
             AS n_rows
      FROM cfg LEFT JOIN std USING (sheet) LEFT JOIN off USING (sheet) LEFT JOIN multi USING (sheet))""")
def parser_choice(spark, sf_dir):
    """Parser per sheet from a config table (by language: standard / offset /
    multi-table / paginated); each sheet goes through its own parser only."""
    docs = tables(spark, sf_dir)["documents"].withColumn(
        "parser", F.when(F.col("lang") == "en", "standard").when(F.col("lang") == "fr", "offset")
        .when(F.col("lang") == "de", "multi").otherwise("paginated"))
    choices = docs.select(F.col("doc_id").cast("string").alias("sheet"), "parser")
    return default_parsers().parse_sheets(G.grid_from_text(docs, sheet="doc_id", text="text"), choices)[1]


@register("orders_sample", "O5", oracle=lambda: """
SELECT * FROM orders ORDER BY md5('7-' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100""")
def orders_sample(spark, sf_dir):
    """A seeded random sample of 100 orders (the limit is the feature)."""
    return R.sample_n(tables(spark, sf_dir)["orders"], 100, "o_orderkey", seed=7)


@register("orders_preview", "O6", oracle=lambda: "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def orders_preview(spark, sf_dir):
    """Table preview: the first 100 rows by key (the limit is the feature)."""
    return R.preview(tables(spark, sf_dir)["orders"], "o_orderkey", n=100)


def _exported(rows, lead, path, n_rows):
    """Text files below ``path``, each ``lead`` lines followed by its share of ``rows`` (column line, key): eight, or as
    many as keep what a task sorts at its size."""
    spark = rows.sparkSession
    n = max(8, -(-n_rows // TASK_ROWS))
    own = rows.select(F.pmod(F.xxhash64("key"), F.lit(n)).alias("part"), F.lit(len(lead)).alias("at"), "line")
    heads = spark.range(n).select(F.col("id").alias("part"), F.posexplode(F.array(*[F.lit(x) for x in lead]))
                                  .alias("at", "line"))
    (own.unionByName(heads).repartition(n, "part").sortWithinPartitions("part", "at")
     .select("part", F.col("line").alias("value")).write.partitionBy("part").text(path))
    return path


def _ledger_lines(spark, sf_dir):
    t = tables(spark, sf_dir)
    part = lookup(t["part"], t["part"].count())
    return t["lineitem"].join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"),
        F.concat_ws(",", F.date_format("l_shipdate", "d MMM yyyy"),
                    F.concat(F.lit('"'), F.col("p_name"), F.lit(", "), F.col("p_brand"), F.lit('"')),
                    F.concat(F.lit('"'), F.format_number(F.floor("l_extendedprice").cast("double"), 2), F.lit('"')),
                    F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber")))
        .alias("line"))


@register("ledger_report_export", "S10", oracle=lambda: """
SELECT CAST(l_shipdate AS DATE) AS "Date", p_name || ', ' || p_brand AS "Description",
       format('{:,.2f}', floor(l_extendedprice)) AS "Debit",
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS "Reference"
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'""")
def ledger_report_export(spark, sf_dir):
    """A ledger report of several files with four title rows each, written and read
    back: quoted commas stay in their cells, rows with an empty cell drop out."""
    lead = ["Ledger", "All accounts", "", "Printed", "Date,Description,Debit,Reference"]
    return io.read_ledger_report(spark, _exported(_ledger_lines(spark, sf_dir), lead, scratch_path(spark, "ledger"),
                                                table_rows(spark, sf_dir, "lineitem")))


@register("parts_csv_export", "S9", oracle=lambda: """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS _code, CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS name FROM part""")
def parts_csv_export(spark, sf_dir):
    """A CSV export with a blank-named column, written and read back: only that column goes."""
    p = tables(spark, sf_dir)["part"]
    rows = p.select(F.col("p_partkey").alias("key"), F.concat_ws(
        ",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), F.lit("x"),
        F.when(F.col("p_size") == 1, "").otherwise(F.col("p_brand"))).alias("line"))
    df = io.read_csv_filled(spark, _exported(rows, ["id,_code,,name"], scratch_path(spark, "parts"),
                                           table_rows(spark, sf_dir, "part")))
    return df.select("id", "_code", "name")


# --------------------------------------------------------------------------- saved queries and their usage
_USES = "SELECT event_type AS query_name, CAST(user_id AS VARCHAR) AS user_email, ts AS last_used_at, event_id AS use_id FROM events"


def _usage(spark, sf_dir):
    """The usage log as it arrives: every event is a use, written in monthly batches of which the last is sent twice."""
    uses = tables(spark, sf_dir)["events"].select(F.col("event_type").alias("query_name"), F.col("user_id").cast("string").alias("user_email"),
                                                  F.col("ts").alias("last_used_at"), F.col("event_id").alias("use_id"))
    batches = uses.withColumn("batch", F.date_format("last_used_at", "yyyy-MM"))
    last = batches.agg(F.max("batch").alias("batch"))
    path = scratch_path(spark, "usage")
    R.append_uses(batches, path)
    R.append_uses(batches.join(last, "batch", "left_semi"), path)
    return R.read_uses(spark, path, uses.schema)


@register("usage_last_used", "R15", oracle=lambda: f"""
SELECT query_name, user_email, max(last_used_at) AS last_used_at, arg_max(use_id, (last_used_at, use_id)) AS use_id, count(*) AS n_uses
FROM ({_USES}) GROUP BY query_name, user_email""")
def usage_last_used(spark, sf_dir):
    """The append-only log compacted to the last use of each (query, user), whatever was sent twice."""
    return R.compact_uses(_usage(spark, sf_dir))


@register("queries_by_last_use", "O4", oracle=lambda: f"""
WITH u AS (SELECT query_name, max(last_used_at) AS last_used_at FROM ({_USES}) GROUP BY query_name),
q AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT p_type FROM part)
SELECT q.name, u.last_used_at, row_number() OVER (ORDER BY u.last_used_at DESC NULLS LAST, q.name) AS place
FROM q LEFT JOIN u ON u.query_name = q.name""")
def queries_by_last_use(spark, sf_dir):
    """The saved queries (event types, and part types, which nobody used) by their last use, never-used last."""
    t = tables(spark, sf_dir)
    saved = t["events"].select(F.col("event_type").alias("name")).union(t["part"].select("p_type")).distinct()
    return R.queries_by_last_use(saved, R.compact_uses(_usage(spark, sf_dir)), place="place")


# --------------------------------------------------------------------------- the labour feed
_DROPS = 2


@register("labour_feed", "W1", oracle=lambda: ctes("labour") + """
SELECT DISTINCT split_part(labour_id, ':', 1) AS task_id, name, employee, start_date, end_date, daily_hours, num_days, total_hours
FROM fx_labour_raw""")
def labour_feed(spark, sf_dir):
    """The bookings sent as JSON files in two drops, the second with half of what came before sent again, through the
    stream (one start per drop, as after restarts) into the labour table."""
    rows, _ = PF.labour_hours(spark, sf_dir)
    own = rows.select(F.substring_index("labour_id", ":", 1).alias("task_id"), "name", "employee", "start_date", "end_date", "daily_hours")
    part = F.pmod(F.xxhash64(*own.columns), F.lit(2 * _DROPS))
    path = scratch_path(spark, "labour-feed")
    own = written(own.withColumn("_part", part), "bookings")
    for drop in range(_DROPS):
        sent = own.filter((F.floor(F.col("_part") / 2) == drop) | (F.floor(F.col("_part") / 2) < drop) & (F.col("_part") % 2 == 0))
        # the files land in one folder, as the scheduler's exports do
        sent.select("*", F.lit(f"2024-01-0{drop + 1}T00:00:00").alias("exported_at")).drop("_part") \
            .write.options(ignoreNullFields="false", compression="gzip", maxRecordsPerFile=TASK_ROWS).json(f"{path}/in/drop={drop}")
        feed.start_feed(spark, f"{path}/in/*", f"{path}/table", f"{path}/state").awaitTermination()
    schema = feed.labour_stream(spark, f"{path}/in/*").schema
    return feed.table(spark, f"{path}/table", schema).drop("exported_at", feed.MONTH, "batch_id")

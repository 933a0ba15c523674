"""Scalar-function and typing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions import text as X
from tradeflow.plans.duck_flow import duck_clean_address, duck_multi_address
from tradeflow.plans.fixtures import duck_cte, fixture, tables
from tradeflow.plans.registry import register

DUCK_NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _duck_money(c: str) -> str:
    return f"CASE WHEN regexp_matches(replace({c}, ',', ''), {DUCK_NUM}) THEN TRY_CAST(replace({c}, ',', '') AS DOUBLE) END"


def _duck_serial(c: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]{{1,9}}$') "
            f"THEN CAST(DATE '1899-12-30' + CAST(trim({c}) AS INTEGER) AS DATE) END")


def typed_ledger(raw):
    """T1 + T2 + T4: money text -> double, serial -> date, gen_proj -> Project."""
    money = ["Debit", "Credit", "Gross", "GST"]
    out = raw.withColumns({c: X.money_to_double(c) for c in money if c in raw.columns})
    out = out.withColumn("Date", X.serial_to_date("Date"))
    return out.withColumnsRenamed({"gen_proj": "Project"})


@register("ledger_typed", "T1,T2,T3,T4,T8,DQ8", oracle=lambda: duck_cte("ledger_text") + f"""
SELECT {_duck_serial('Date')} AS Date, Account, Description, Reference,
       {_duck_money('Debit')} AS Debit, {_duck_money('Credit')} AS Credit, {_duck_money('Gross')} AS Gross,
       {_duck_money('GST')} AS GST, gen_proj AS Project
FROM fx_ledger_text WHERE {_duck_serial('Date')} IS NOT NULL""")
def ledger_typed(spark, sf_dir):
    """Typed ledger rows with a date (T3 keeps rows whose date parsed)."""
    t = typed_ledger(fixture(spark, sf_dir, "ledger_text"))
    return t.filter(F.col("Date").isNotNull())


@register("ledger_null_dates", "T3,K4", oracle=lambda: duck_cte("ledger_text") + f"""
SELECT Reference, count(*) AS n_removed FROM fx_ledger_text WHERE {_duck_serial('Date')} IS NULL GROUP BY Reference""")
def ledger_null_dates(spark, sf_dir):
    """T3 reject side: removed (null-date) rows counted per reference."""
    t = typed_ledger(fixture(spark, sf_dir, "ledger_text"))
    return t.filter(F.col("Date").isNull()).groupBy("Reference").agg(F.count(F.lit(1)).alias("n_removed"))


def _addr_inputs(spark, sf_dir):
    ct = fixture(spark, sf_dir, "customer_titles")
    seg = F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.expr("substr(c_mktsegment, 2)")))
    return ct.withColumn("unit_addr", F.concat(F.col("c_nationkey").cast("string"), F.lit("/"),
                                               F.col("c_custkey").cast("string"), F.lit("B "), seg))


@register("address_clean", "F1,F2,F10,F17", oracle=lambda: duck_cte("customer_titles") + f""",
a AS (SELECT *, CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) || 'B '
             || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS unit_addr
      FROM fx_customer_titles)
SELECT c_custkey, {duck_clean_address('title')} AS job_name,
       {duck_multi_address(duck_clean_address('title'))} AS simple_name,
       {duck_multi_address('unit_addr')} AS unit_simple,
       CASE WHEN contains(title, ',') THEN split_part(title, ', ', 2) END AS suburb,
       contains(lower(title), 'household st') AS is_household_street
FROM a""")
def address_clean(spark, sf_dir):
    a = _addr_inputs(spark, sf_dir)
    name = X.clean_address_suffix("title")
    return a.select("c_custkey", name.alias("job_name"),
                    X.clean_multi_address(name).alias("simple_name"),
                    X.clean_multi_address("unit_addr").alias("unit_simple"),
                    X.suburb("title").alias("suburb"),
                    X.contains_casefold(F.col("title"), "Household St").alias("is_household_street"))


_DUCK_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"


@register("url_parts", "F11,F15", oracle=lambda: f"""
SELECT page_id, regexp_extract(url, {_DUCK_URL}, 2) AS host, regexp_extract(url, {_DUCK_URL}, 3) AS path,
       regexp_extract(url, {_DUCK_URL}, 4) AS query, 'https://www.trello.com/c/' || CAST(page_id AS VARCHAR) AS card_url
FROM pages""")
def url_parts(spark, sf_dir):
    p = tables(spark, sf_dir)["pages"]
    return p.select("page_id", X.url_part("url", "host").alias("host"), X.url_part("url", "path").alias("path"),
                    X.url_part("url", "query").alias("query"),
                    X.url_from_short_id(F.col("page_id").cast("string")).alias("card_url"))


@register("epoch_text", "F6,F7,T12", oracle=lambda: """
SELECT event_id,
       strftime(epoch_ms(1600000000000 + event_id * 60000), '%Y-%m-%d %H:%M:%S') AS from_epoch,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS iso_date,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text
FROM events""")
def epoch_text(spark, sf_dir):
    e = tables(spark, sf_dir)["events"]
    txt = F.concat(F.lit("/Date("), (F.lit(1600000000000) + F.col("event_id") * 60000).cast("string"), F.lit("+0000)/"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select("event_id",
                    X.datetime_to_text(X.epoch_ms_in_text(txt)).alias("from_epoch"),
                    X.iso_to_date(iso).cast("string").alias("iso_date"),
                    X.datetime_to_text("ts").alias("ts_text"))


@register("template_vars", "F14", oracle=lambda: r"""
SELECT event_id, regexp_extract_all('SELECT * FROM t WHERE a = {{ ' || event_type || ' }} AND b > {{since}}',
                                    '\{\{\s*(\w+)\s*\}\}', 1) AS variables
FROM events""")
def template_vars(spark, sf_dir):
    e = tables(spark, sf_dir)["events"]
    tpl = F.concat(F.lit("SELECT * FROM t WHERE a = {{ "), F.col("event_type"), F.lit(" }} AND b > {{since}}"))
    return e.select("event_id", X.template_variables(tpl).alias("variables"))


@register("field_names", "F3,F16", oracle=lambda: """
SELECT p_partkey,
       replace(replace(lower(replace(replace(replace(replace(replace(replace(
         p_type || ' (' || p_brand || ')/' || p_name || ': 2nd', ' ', '_'), '(', '_'), ')', ''), '+', '_'), '/', '-'),
         '__', '_')), ':', ''), '2nd', 'second') AS field,
       'Name: ' || coalesce(p_name, '') || chr(10) || 'Brand: ' || coalesce(p_brand, '') AS description
FROM part""")
def field_names(spark, sf_dir):
    p = tables(spark, sf_dir)["part"]
    raw = F.concat(F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")/"), F.col("p_name"), F.lit(": 2nd"))
    return p.select("p_partkey", X.clean_field_name_col(raw).alias("field"),
                    X.description_text([("Name", "p_name"), ("Brand", "p_brand")]).alias("description"))


@register("text_datetimes", "T12", oracle=lambda: """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) END AS ts
FROM lineitem""")
def text_datetimes(spark, sf_dir):
    """Text to timestamp; bad text gives null."""
    from pyspark.sql import functions as F

    from tradeflow.functions.text import text_to_datetime
    from tradeflow.plans.fixtures import tables
    li = tables(spark, sf_dir)["lineitem"]
    text = F.when(F.col("l_linenumber") == 3, "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return li.select("l_orderkey", "l_linenumber", text_to_datetime(text).alias("ts"))

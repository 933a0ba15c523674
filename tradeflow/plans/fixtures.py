"""Operator inputs derived from the driver's star-schema tables.

The reference works on job cards, quotes, labour bookings and cost ledgers;
the driver gives TPC-H-like tables. Each fixture below is a *view
definition*: a small SQL text, written once, that Spark runs through
``spark.sql(text, **dataframes)`` and that the DuckDB oracle embeds as a CTE.
The library operators are then applied on the Spark side only; the oracle
re-states their semantics in plain SQL. Everything grows with the input
tables (no sampling, no key subsets).

World (one row per):
  job_cards   customer  — title ``<custkey> <Segment> <Suffix>, <NATION>``
  quote lines lineitem  — quote = order; source A = open lines, B = finished
  tasks       lineitem  — scheduler booking, person = supplier
  costs       lineitem  — ledger row whose text names the customer's job
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tradeflow.session import dealt, lookup

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Dialect:
    """The few spellings that differ between Spark SQL and DuckDB."""

    def __init__(self, name: str):
        self.name = name

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.name == "spark" else f"[{', '.join(items)}]"

    def drop_nulls(self, arr: str) -> str:
        if self.name == "spark":
            return f"filter({arr}, x -> x IS NOT NULL)"
        return f"list_filter({arr}, lambda x: x IS NOT NULL)"

    def add_days(self, d: str, n: str) -> str:
        return f"date_add({d}, {n})" if self.name == "spark" else f"CAST({d} + to_days(CAST({n} AS INTEGER)) AS DATE)"

    def money_text(self, x: str) -> str:
        # 12345.6 -> '12,345.60'
        return (f"format_number(floor(({x}) * 100) / 100.0, 2)" if self.name == "spark"
                else f"format('{{:,.2f}}', floor(({x}) * 100) / 100.0)")


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")


def _title_case(col: str) -> str:
    return f"(upper(substr({col}, 1, 1)) || lower(substr({col}, 2)))"


# Street suffix per region, so titles carry suffixes that F1 removes.
_SUFFIX = ("CASE n.n_regionkey WHEN 0 THEN 'Street' WHEN 1 THEN 'Road' WHEN 2 THEN 'Avenue' "
           "WHEN 3 THEN 'St' ELSE 'Crescent' END")


_ITEM_PREFIX = ("CASE p.p_type WHEN 'ECONOMY' THEN 'Remove and replace sewer pipe - ' "
                "WHEN 'PROMO' THEN 'Remove and replace stormwater drain - ' "
                "WHEN 'SMALL' THEN 'Remove and replace concrete path - ' "
                "WHEN 'LARGE' THEN 'Gully trap with bubble up sump - ' "
                "WHEN 'MEDIUM' THEN 'Double cut driveway, pipelining - ' "
                "ELSE 'Fence and clothes line reinstate - ' END")


# Attachments of unshared jobs: every class, and both kinds that are skipped.
_ATTACHMENT = ("CASE t.n_regionkey WHEN 0 THEN 'https://trello.com/1/cards/c' || CAST(t.c_custkey AS STRING) || '/site.HEIC' "
               "WHEN 1 THEN 'https://trello.com/1/cards/c' || CAST(t.c_custkey AS STRING) || '/plan.pdf' "
               "WHEN 2 THEN 'https://trello.com/1/cards/c' || CAST(t.c_custkey AS STRING) || '/set.rar' "
               "WHEN 3 THEN CASE t.c_mktsegment WHEN 'AUTOMOBILE' THEN 'https://trello.com/1/x/mail.eml' "
               "WHEN 'BUILDING' THEN 'https://trello.com/1/x/walk.mov' WHEN 'FURNITURE' THEN 'https://trello.com/b/board' "
               "WHEN 'HOUSEHOLD' THEN 'https://trello.com/1/x/noname' "
               "ELSE 'https://drive.google.com/drive/x?usp=drive_link' END "
               "ELSE CASE t.c_mktsegment WHEN 'AUTOMOBILE' THEN 'https://drive.google.com/drive/folders/x' "
               "WHEN 'BUILDING' THEN 'https://mail.google.com/mail/x' WHEN 'FURNITURE' THEN 'https://go.xero.com/x' "
               "WHEN 'HOUSEHOLD' THEN 'https://docs.google.com/document/d/x' ELSE 'https://example.com/x' END END")


def _job_title_select() -> str:
    """customer ⋈ nation -> (c_custkey, title, job_name_raw)."""
    seg = _title_case("c.c_mktsegment")
    return (
        f"SELECT c.*, n.n_name, n.n_regionkey, "
        f"CAST(c.c_custkey AS STRING) || ' ' || {seg} || ' ' || {_SUFFIX} || ', ' || n.n_name AS title, "
        f"CAST(c.c_custkey AS STRING) || ' ' || {seg} AS short_name "
        f"FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"
    )


LINES = f"""FROM {{lineitem}} l
JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
JOIN {{part}} p ON l.l_partkey = p.p_partkey
JOIN ({_job_title_select()}) ct ON o.o_custkey = ct.c_custkey"""
TASK_LINES = f"""FROM {{lineitem}} l
JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
JOIN ({_job_title_select()}) ct ON o.o_custkey = ct.c_custkey"""
# The same on Spark: titles meet the orders before the lines do, so that each line moves once or, with parts, twice, the
# first time without what it is to get.
_SPARK_LINES = {LINES: "FROM ({lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey) JOIN {titled_orders} oc ON l.l_orderkey = oc.o_orderkey",
                TASK_LINES: "FROM {lineitem} l JOIN {titled_orders} oc ON l.l_orderkey = oc.o_orderkey"}


def sql_customer_titles(d: Dialect) -> str:
    return _job_title_select()


def sql_quote_source_a(d: Dialect) -> str:
    """Accounting-system quote lines (already carry line_pct and extra ids)."""
    return f"""
SELECT 'Q' || CAST(o.o_orderkey AS STRING) AS quote_no,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Variation - ' ELSE '' END || ct.title AS quote_ref,
       ct.c_name AS customer,
       o.o_orderstatus AS quote_status,
       {_ITEM_PREFIX} || p.p_name AS item_desc,
       p.p_brand AS item_code,
       l.l_discount AS line_pct,
       l.l_quantity AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price,
       l.l_extendedprice AS line_total,
       o.o_orderdate AS created,
       CAST(l.l_shipdate AS DATE) AS updated,
       'qid-' || CAST(o.o_orderkey AS STRING) AS quote_id,
       'lid-' || CAST(o.o_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS line_id,
       'cid-' || CAST(o.o_custkey AS STRING) AS contact_id
{LINES}
WHERE l.l_linestatus = 'O'"""


def sql_quote_source_b(d: Dialect) -> str:
    """Job-management quote lines: different names, percentage inside the item text."""
    return f"""
SELECT 'Q' || CAST(o.o_orderkey AS STRING) AS quote_no,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Variation - ' ELSE '' END || ct.title AS site,
       ct.c_name AS customer,
       {_ITEM_PREFIX} || p.p_name || ' at ' || CAST(CAST(round(l.l_discount * 100) AS INT) AS STRING) || '%' AS item,
       l.l_quantity AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price,
       l.l_extendedprice AS total,
       CAST(o.o_orderdate AS DATE) AS date_created,
       o.o_totalprice AS quote_total,
       CAST(l.l_shipdate AS DATE) AS date_approved
{LINES}
WHERE l.l_linestatus = 'F'"""


def sql_job_cards(d: Dialect) -> str:
    """One card per customer.

    Cards with ``c_acctbal < 1000`` carry the ``Shared Drain`` label and link
    to the previous and next such card of the same (nation, segment, block
    of 500 customer keys — so groups stay small at any scale), as
    attachment URLs ``https://trello.com/c/<short>/<slug>``. Some titles are
    marked as duplicates or do not start with a digit (P1 rejects).
    """
    seg = _title_case("t.c_mktsegment")
    link = "'https://trello.com/c/c' || CAST({k} AS STRING) || '/card'"
    win = ("OVER (PARTITION BY t.c_nationkey, t.c_mktsegment, CAST(floor(t.c_custkey / 500) AS BIGINT), "
           "(t.c_acctbal < 1000) ORDER BY t.c_custkey)")
    prev_k = f"lag(t.c_custkey) {win}"
    next_k = f"lead(t.c_custkey) {win}"
    return f"""
SELECT t.c_custkey AS card_id,
       'c' || CAST(t.c_custkey AS STRING) AS short_url,
       'https://trello.com/c/c' || CAST(t.c_custkey AS STRING) AS url,
       CASE WHEN t.c_acctbal > 9500 THEN 'Survey Workflow' ELSE 'Current Jobs' END AS board_name,
       CASE WHEN t.c_acctbal > 9900 THEN 'Duplicate ' || t.title
            WHEN t.c_acctbal < -990 THEN 'Site ' || t.title
            ELSE t.title END AS card_title,
       CASE WHEN t.c_acctbal < 0 THEN 'Declined'
            WHEN t.c_acctbal < 3000 THEN 'Approved'
            WHEN t.c_acctbal < 6000 THEN 'Awaiting Approval'
            WHEN t.c_acctbal < 8000 THEN 'NFA, No Damage, PVC'
            ELSE 'Completed' END AS status,
       CASE WHEN t.c_acctbal < 1000 THEN {d.arr("'Shared Drain'")} ELSE {d.arr("'Standard'")} END AS labels,
       t.title AS address,
       CASE WHEN t.c_acctbal < 1000 THEN {d.drop_nulls(d.arr(
           f"CASE WHEN {prev_k} IS NULL THEN NULL ELSE {link.format(k=prev_k)} END",
           f"CASE WHEN {next_k} IS NULL THEN NULL ELSE {link.format(k=next_k)} END"))}
            ELSE {d.arr(_ATTACHMENT)} END AS attachments,
       t.c_name AS customer_name,
       lower(replace(t.c_name, '#', '.')) || '@example.com' AS customer_email,
       CASE WHEN t.c_acctbal < 5000 THEN 'PM ' || {seg} ELSE NULL END AS project_manager,
       CASE WHEN t.c_acctbal >= 2000 THEN 'Surveyor ' || CAST(t.c_nationkey AS STRING) ELSE NULL END AS surveyed_by,
       {d.add_days("CAST('2020-01-01' AS DATE)", "CAST(floor(t.c_acctbal / 10) AS INT)")} AS report_sent_to_eqc,
       CASE WHEN t.c_acctbal >= 2000 THEN {d.add_days("CAST('2020-01-01' AS DATE)", "CAST(floor(t.c_acctbal / 10) AS INT) + CAST(floor(t.c_acctbal / 250) AS INT) - 7")} END AS eqc_approved_date,
       CASE WHEN t.c_acctbal < 0 THEN {d.add_days("CAST('2020-06-01' AS DATE)", "CAST(floor(-t.c_acctbal) AS INT)")} END AS eqc_declined_date,
       floor(t.c_acctbal) / 100.0 AS concrete_qty,
       CASE WHEN t.c_acctbal > 0 THEN floor(t.c_acctbal / 2.5) / 100.0 ELSE NULL END AS asphalt_qty,
       CAST(-36.0 - t.c_nationkey / 10.0 AS DOUBLE) AS latitude,
       CAST(174.0 + t.n_regionkey / 10.0 AS DOUBLE) AS longitude
FROM ({_job_title_select()}) t"""


def sql_tasks(d: Dialect) -> str:
    """Scheduler bookings: one per line; the first line of an order has a blank name;
    returned lines list two people (the second id may not exist). Customers with a
    balance between 9,000 and 9,400 are not booked yet."""
    return f"""
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS task_id,
       o.o_custkey AS project_id,
       CASE WHEN l.l_linenumber = 1 THEN '' ELSE ct.title END AS name,
       CAST(o.o_orderdate AS DATE) AS start_date,
       {d.add_days("CAST(o.o_orderdate AS DATE)", "l.l_linenumber - 1")} AS end_date,
       l.l_suppkey AS people_id,
       CASE WHEN l.l_returnflag = 'R' THEN {d.arr("l.l_suppkey", "l.l_suppkey + 1")} ELSE NULL END AS people_ids,
       l.l_quantity / 10.0 AS hours
{TASK_LINES}
WHERE NOT (ct.c_acctbal BETWEEN 9000 AND 9400)"""


def sql_people(d: Dialect) -> str:
    return "SELECT s_suppkey AS people_id, s_name AS name FROM {supplier}"


def sql_sched_projects(d: Dialect) -> str:
    return f"SELECT c_custkey AS project_id, title AS name FROM ({_job_title_select()}) t"


def sql_costs(d: Dialect) -> str:
    """Typed cost ledger rows; Description names the customer's short job name."""
    return f"""
SELECT CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) AS row_id,
       CAST(l.l_shipdate AS DATE) AS Date,
       CASE l.l_returnflag WHEN 'R' THEN 'Bill' WHEN 'A' THEN 'Spend Money' ELSE 'Credit Note' END AS Source,
       p.p_name || ' for ' || ct.short_name AS Description,
       'INV-' || CAST(l.l_orderkey AS STRING) AS Reference,
       floor(l.l_extendedprice) / 100.0 AS Debit,
       CAST(NULL AS DOUBLE) AS Credit,
       floor(l.l_extendedprice * (1 + l.l_tax)) / 100.0 AS Gross,
       floor(l.l_extendedprice) / 100.0 AS net,
       floor(l.l_extendedprice * l.l_tax) / 100.0 AS GST,
       p.p_type AS Account,
       CASE WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'N' AND l.l_linenumber = 1 THEN ct.short_name
            WHEN l.l_linestatus = 'O' THEN ct.title ELSE '' END AS Project
{LINES}"""


def sql_ledger_text(d: Dialect) -> str:
    """Untyped ledger export (every cell text): serial dates, money with commas,
    some bad cells. Used by T1-T4 / S10."""
    serial = "CAST(datediff(CAST(l.l_shipdate AS DATE), CAST('1899-12-30' AS DATE)) AS STRING)" if d.name == "spark" \
        else "CAST(date_diff('day', CAST('1899-12-30' AS DATE), CAST(l.l_shipdate AS DATE)) AS VARCHAR)"
    return f"""
SELECT CASE WHEN l.l_linenumber = 7 THEN 'n/a' WHEN l.l_linenumber = 6 AND l.l_returnflag = 'N' THEN NULL
            ELSE {serial} END AS Date,
       p.p_type AS Account,
       p.p_name AS Description,
       'INV-' || CAST(l.l_orderkey AS STRING) AS Reference,
       {d.money_text('l.l_extendedprice')} AS Debit,
       CASE WHEN l.l_returnflag = 'R' THEN {d.money_text('-l.l_extendedprice * l.l_tax')} ELSE NULL END AS Credit,
       CASE WHEN l.l_linenumber = 5 THEN 'invalid' ELSE {d.money_text('l.l_extendedprice * (1 + l.l_tax)')} END AS Gross,
       {d.money_text('l.l_extendedprice * l.l_tax')} AS GST,
       'INV-' || CAST(l.l_orderkey AS STRING) || ' ' || p.p_brand AS gen_proj
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey"""


FIXTURES = {
    "customer_titles": sql_customer_titles,
    "quote_src_a": sql_quote_source_a,
    "quote_src_b": sql_quote_source_b,
    "job_cards": sql_job_cards,
    "tasks": sql_tasks,
    "people": sql_people,
    "sched_projects": sql_sched_projects,
    "costs": sql_costs,
    "ledger_text": sql_ledger_text,
}


class Tables(dict):
    """Parquet readers by table name, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in BASE_TABLES:
            raise KeyError(name)
        self[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self[name]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy parquet readers for the driver tables (column pruning and filter
    pushdown reach the scans through every plan built on them)."""
    return Tables(spark, sf_dir)


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The rows of a driver table, from the footers of its files."""
    return tables(spark, sf_dir)[name].count()


def _lines(spark: SparkSession, base: Tables, text: str) -> tuple[str, dict[str, DataFrame]]:
    """A text over lines as Spark runs it, and its tables: orders with their customers' titles (``o`` and ``ct`` in one,
    ``oc``), dealt over as many tasks as the lines need."""
    for plain, own in _SPARK_LINES.items():
        text = re.sub(r"\b(?:o|ct)\.", "oc.", text[:text.index(plain)]) + own + \
            re.sub(r"\b(?:o|ct)\.", "oc.", text[text.index(plain) + len(plain):]) if plain in text else text
    n = base["lineitem"].count()
    titles = spark.sql(_job_title_select(), customer=base["customer"], nation=base["nation"])
    orders = spark.sql("SELECT o.*, ct.* FROM {orders} o JOIN {titles} ct ON o.o_custkey = ct.c_custkey",
                       orders=base["orders"], titles=lookup(titles, base["customer"].count()))
    used = {"lineitem": base["lineitem"], "titled_orders": dealt(orders, n, "o_orderkey")}
    if "{part}" in text:
        used |= {"lineitem": dealt(base["lineitem"], n, "l_partkey"), "part": lookup(base["part"], base["part"].count())}
    return text, used


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run a fixture view definition on Spark over the parquet tables."""
    text = FIXTURES[name](SPARK)
    base = tables(spark, sf_dir)
    if any(plain in text for plain in _SPARK_LINES):
        text, used = _lines(spark, base, text)
    else:
        used = {t: base[t] for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixtures for the DuckDB oracle."""
    parts = []
    for n in names:
        text = FIXTURES[n](DUCK)
        for t in BASE_TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"fx_{n} AS MATERIALIZED ({text})")
    return "WITH " + ",\n".join(parts) + "\n"

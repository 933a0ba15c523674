"""Nested-JSON source queries.

The JSON documents are produced by Spark from the driver tables (one board
document per customer, one quote page per line item) and then read back
through the same flatteners a real export would go through.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.sources import nested as N
from tradeflow.plans.fixtures import tables
from tradeflow.plans.registry import register

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def board_docs(spark, sf_dir):
    """Board JSON documents of up to 50 cards (customers) of a nation, each with the five
    segments as lists, of which MACHINERY is closed."""
    t = tables(spark, sf_dir)
    c = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    options = F.array(*[F.struct(F.lit(f"o{i}").alias("id"), F.struct(F.lit(s).alias("text")).alias("value"))
                        for i, s in enumerate(SEGMENTS)])
    seg_opt = F.concat(F.lit("o"), F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
                       .cast("int") - 1)
    card = F.struct(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("shortLink"),
        F.concat(F.lit("l"), F.col("c_mktsegment")).alias("idList"),
        F.array(F.struct(F.when(F.col("c_acctbal") < 0, "Overdue").otherwise("Standard").alias("name"))).alias("labels"),
        F.array(F.struct(F.concat(F.lit("https://trello.com/c/s"), F.col("c_custkey").cast("string"),
                                  F.lit("/plan.pdf")).alias("url"))).alias("attachments"),
        F.array(
            F.struct(F.lit("cf1").alias("idCustomField"), F.lit(None).cast("string").alias("idValue"),
                     F.struct(F.lit(None).cast("string").alias("text"), F.col("c_acctbal").cast("string").alias("number"),
                              F.lit(None).cast("string").alias("checked"), F.lit(None).cast("string").alias("date"))
                     .alias("value")),
            F.struct(F.lit("cf2").alias("idCustomField"), seg_opt.alias("idValue"),
                     F.lit(None).cast(N.CUSTOM_VALUE).alias("value"))).alias("customFieldItems"),
        F.array(F.struct(F.lit("Tasks").alias("name"), F.array(
            F.struct(F.lit("survey").alias("name"), F.lit("complete").alias("state"), F.lit(None).cast("string").alias("due")),
            F.struct(F.lit("report").alias("name"),
                     F.when(F.col("c_acctbal") > 5000, "complete").otherwise("incomplete").alias("state"),
                     F.lit(None).cast("string").alias("due"))).alias("checkItems"))).alias("checklists"),
    )
    doc = F.struct(
        F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
        F.array(*[F.struct(F.lit(f"l{x}").alias("id"), F.lit(x).alias("name"), F.lit(x == "MACHINERY").alias("closed"))
                  for x in SEGMENTS]).alias("lists"),
        F.array(F.struct(F.lit("cf1").alias("id"), F.lit("Acct Bal").alias("name"), F.lit("number").alias("type"),
                         F.lit(None).cast("array<struct<id:string,value:struct<text:string>>>").alias("options")),
                F.struct(F.lit("cf2").alias("id"), F.lit("Segment").alias("name"), F.lit("list").alias("type"),
                         options.alias("options"))).alias("customFields"),
        F.col("cards"))
    c = c.groupBy("n_nationkey", "n_name", F.floor(F.col("c_custkey") / 50)).agg(F.collect_list(card).alias("cards"))
    return c.select(F.to_json(doc).alias("json")).select(F.from_json("json", N.BOARD_SCHEMA).alias("b")).select("b.*")


@register("board_cards", "S1,U4", oracle=lambda: """
SELECT n.n_name AS board_name, 'c' || CAST(c.c_custkey AS VARCHAR) AS id, c.c_name AS name,
       CASE WHEN c.c_mktsegment <> 'MACHINERY' THEN c.c_mktsegment END AS list_name,
       [CASE WHEN c.c_acctbal < 0 THEN 'Overdue' ELSE 'Standard' END] AS labels,
       ['https://trello.com/c/s' || CAST(c.c_custkey AS VARCHAR) || '/plan.pdf'] AS attachments
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def board_cards(spark, sf_dir):
    cards = N.board_cards(board_docs(spark, sf_dir))
    return cards.select("board_name", "id", "name", "list_name", "labels", "attachments")


@register("card_custom_fields", "S2,A19", oracle=lambda: """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS card_id, CAST(c_acctbal AS VARCHAR) AS "Acct Bal",
       c_mktsegment AS "Segment"
FROM customer""")
def card_custom_fields(spark, sf_dir):
    vals = N.custom_field_values(board_docs(spark, sf_dir))
    return N.pivot_fields(vals, key="card_id", field="field", value="value", fields=["Acct Bal", "Segment"])


@register("card_checklists", "S4", oracle=lambda: """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS card_id, 'Tasks' AS checklist, 'survey' AS item, 'complete' AS state,
       CAST(NULL AS VARCHAR) AS due FROM customer
UNION ALL
SELECT 'c' || CAST(c_custkey AS VARCHAR), 'Tasks', 'report',
       CASE WHEN c_acctbal > 5000 THEN 'complete' ELSE 'incomplete' END, NULL FROM customer""")
def card_checklists(spark, sf_dir):
    return N.checklist_items(board_docs(spark, sf_dir))


def quote_pages(spark, sf_dir):
    """One page per customer with all its quotes (orders) and their lines; status 'P'
    orders are exported as DELETED, urgent ones without a status, low ones without a
    reference and lines of returned goods without an item code."""
    t = tables(spark, sf_dir)
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    li = F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("LineItemID"),
                  F.when(F.col("l_returnflag") != "R", F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("ItemCode"),
                  F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.when(
                      F.col("l_linenumber") == 2, F.lit(" at 12.5%")).otherwise(F.lit(""))).alias("Description"),
                  F.col("l_quantity").alias("Quantity"),
                  (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitAmount"),
                  F.col("l_extendedprice").alias("LineAmount"))
    q = j.groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate").agg(
        F.collect_list(li).alias("items")).select("o_custkey", F.struct(
            F.concat(F.lit("id-"), F.col("o_orderkey").cast("string")).alias("QuoteID"),
            F.concat(F.lit("QU-"), F.col("o_orderkey").cast("string")).alias("QuoteNumber"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
            .alias("Reference"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("string"))
            .when(F.col("o_orderstatus") == "P", "DELETED").otherwise("ACCEPTED").alias("Status"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("DateString"),
            F.concat(F.lit("/Date("), F.unix_millis(F.date_add(F.col("o_orderdate").cast("date"), 3650).cast("timestamp")).cast("string"),
                     F.lit("+0000)/")).alias("UpdatedDateUTC"),
            F.struct(F.concat(F.lit("cid-"), F.col("o_custkey").cast("string")).alias("ContactID"),
                     F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("Name"),
                     F.lit("x@example.com").alias("EmailAddress")).alias("Contact"),
            F.col("items").alias("LineItems")).alias("q"))
    return q.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list("q").alias("Quotes"))).alias("json")).select("json")


_QUOTE_LINES = """
SELECT 'QU-' || CAST(o_orderkey AS VARCHAR) AS quote_no,
       CASE WHEN o_orderpriority <> '5-LOW' THEN 'Order ' || CAST(o_orderkey AS VARCHAR) END AS quote_ref,
       'Customer ' || CAST(o_custkey AS VARCHAR) AS customer, 'id-' || CAST(o_orderkey AS VARCHAR) AS quote_id,
       'cid-' || CAST(o_custkey AS VARCHAR) AS contact_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'ACCEPTED' END AS quote_status,
       CAST(o_orderdate AS DATE) AS created, CAST(o_orderdate AS DATE) + 3650 AS updated,
       CASE WHEN l_linenumber = 2 THEN {pct} ELSE 1.0 END AS line_pct,
       CASE WHEN l_returnflag <> 'R' THEN 'P' || CAST(l_partkey AS VARCHAR) END AS item_code,
       'part ' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_linenumber = 2 THEN ' at 12.5%' ELSE '' END AS item_desc,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_id, l_quantity AS quantity,
       l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' OR o_orderstatus <> 'P'"""


@register("quote_json_lines", "S6,F7", oracle=lambda: _QUOTE_LINES.format(pct="0.13"))
def quote_json_lines(spark, sf_dir):
    return N.quote_lines_from_json(quote_pages(spark, sf_dir))[0]


@register("quote_json_human", "S6", oracle=lambda: f"""
SELECT * EXCLUDE (quote_id, contact_id, line_id) FROM ({_QUOTE_LINES.format(pct="0.13")})""")
def quote_json_human(spark, sf_dir):
    """The lines as people read them, without technical ids."""
    return N.human_lines(N.quote_lines_from_json(quote_pages(spark, sf_dir))[0])


@register("quote_json_errors", "S6", oracle=lambda: f"""
SELECT quote_no, line_id, 'no_ItemCode' AS error FROM ({_QUOTE_LINES.format(pct="0.13")}) WHERE item_code IS NULL
UNION ALL SELECT DISTINCT quote_no, CAST(NULL AS VARCHAR), 'no_reference' FROM ({_QUOTE_LINES.format(pct="0.13")})
WHERE quote_ref IS NULL""")
def quote_json_errors(spark, sf_dir):
    return N.quote_lines_from_json(quote_pages(spark, sf_dir))[1]


@register("board_lists", "S3", oracle=lambda: """
SELECT DISTINCT 'b' || CAST(n.n_nationkey AS VARCHAR) AS board_id, n.n_name AS board_name, 'l' || s AS list_id, s AS list_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey,
     LATERAL (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD')) v(s)""")
def board_lists(spark, sf_dir):
    """The open lists of every board."""
    return N.open_lists(board_docs(spark, sf_dir)).distinct()


@register("board_fields", "S3", oracle=lambda: """
SELECT DISTINCT 'b' || CAST(n_nationkey AS VARCHAR) AS board_id, n_name AS board_name, f AS field_id, x AS field_name, t AS field_type
FROM customer JOIN nation ON c_nationkey = n_nationkey, LATERAL (VALUES ('cf1', 'Acct Bal', 'number'), ('cf2', 'Segment', 'list')) v(f, x, t)""")
def board_fields(spark, sf_dir):
    """The custom fields of every board."""
    return N.field_definitions(board_docs(spark, sf_dir))


@register("board_field_options", "S3", oracle=lambda: """
SELECT DISTINCT 'b' || CAST(c_nationkey AS VARCHAR) AS board_id, 'cf2' AS field_id, 'Segment' AS field_name, 'o' || CAST(i AS VARCHAR) AS option_id,
       s AS "option", i AS place
FROM customer, LATERAL (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD'), (4, 'MACHINERY')) v(i, s)""")
def board_field_options(spark, sf_dir):
    """The options of the boards' dropdown fields."""
    return N.field_options(board_docs(spark, sf_dir))


@register("board_labels", "S3", oracle=lambda: """
SELECT 'b' || CAST(c_nationkey AS VARCHAR) AS board_id, CASE WHEN c_acctbal < 0 THEN 'Overdue' ELSE 'Standard' END AS label, count(*) AS n_cards
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def board_labels(spark, sf_dir):
    """The labels in use on every board."""
    return N.board_labels(board_docs(spark, sf_dir))


@register("board_cards_text", "T8,D4", oracle=lambda: """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, '["' || CASE WHEN c_acctbal < 0 THEN 'Overdue' ELSE 'Standard' END || '"]'
       AS labels, '["https://trello.com/c/s' || CAST(c_custkey AS VARCHAR) || '/plan.pdf"]' AS attachments
FROM customer""")
def board_cards_text(spark, sf_dir):
    """Complex columns as JSON text."""
    return N.complex_to_text(N.board_cards(board_docs(spark, sf_dir)).select("id", "labels", "attachments"))


@register("event_props", "T7", oracle=lambda: """
SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def event_props(spark, sf_dir):
    e = tables(spark, sf_dir)["events"]
    return e.select("event_id", "user_id", "event_type", F.from_json("props", "k int").alias("p")).select(
        "event_id", "user_id", "event_type", "p.k")

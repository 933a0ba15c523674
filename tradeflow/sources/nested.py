"""Nested JSON sources.

All flattening is ``from_json`` / ``spark.read.json`` with a declared schema
followed by ``explode`` / ``posexplode`` — no Python parsing. Custom-field
pivots always receive the declared value list, so no extra scan is needed
to discover pivot columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Board JSON (S1-S4): a generic subset of the kanban export.
CUSTOM_VALUE = T.StructType([T.StructField("text", T.StringType()), T.StructField("number", T.StringType()),
                             T.StructField("checked", T.StringType()), T.StructField("date", T.StringType())])
BOARD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("lists", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("closed", T.BooleanType())]))),
    T.StructField("customFields", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("options", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()), T.StructField("value", T.StructType([
                T.StructField("text", T.StringType())]))])))]))),
    T.StructField("cards", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("shortLink", T.StringType()), T.StructField("idList", T.StringType()),
        T.StructField("desc", T.StringType()), T.StructField("due", T.StringType()), T.StructField("url", T.StringType()),
        T.StructField("coordinates", T.StructType([T.StructField("latitude", T.DoubleType()),
                                                   T.StructField("longitude", T.DoubleType())])),
        T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))),
        T.StructField("customFieldItems", T.ArrayType(T.StructType([
            T.StructField("idCustomField", T.StringType()), T.StructField("idValue", T.StringType()),
            T.StructField("value", CUSTOM_VALUE)]))),
        T.StructField("checklists", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("checkItems", T.ArrayType(T.StructType([
                T.StructField("name", T.StringType()), T.StructField("state", T.StringType()),
                T.StructField("due", T.StringType())])))])))]))),
])


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """S1 source: one board document per line (or multi-line with ``multiLine``)."""
    return spark.read.schema(BOARD_SCHEMA).json(path)


def board_cards(boards: DataFrame) -> DataFrame:
    """One row per card with board name, list name (resolved inside the
    card's own board document: no join, open lists only), label names and
    attachment URLs as arrays, and the card position as a stable order."""
    cards = boards.select(F.col("name").alias("board_name"), F.col("id").alias("board_id"), "lists",
                          F.posexplode("cards").alias("card_pos", "c"))
    list_name = F.try_element_at(F.filter("lists", lambda l: (l["id"] == F.col("c.idList"))
                                      & ~F.coalesce(l["closed"], F.lit(False))), F.lit(1))["name"]
    return cards.select("board_name", "board_id", "card_pos", "c.id", "c.name", "c.shortLink", "c.idList",
                        list_name.alias("list_name"),
                        F.transform("c.labels", lambda x: x["name"]).alias("labels"),
                        F.transform("c.attachments", lambda x: x["url"]).alias("attachments"),
                        "c.desc", "c.due", "c.url", "c.coordinates.latitude", "c.coordinates.longitude")


def custom_field_values(boards: DataFrame) -> DataFrame:
    """(card id, field name, value text) — value by field type; a ``list``
    field resolves its dropdown option text; unknown types -> null. Field
    definitions are looked up inside the card's own board document (array
    lookup on the row, no join, so documents never pair with each other)."""
    items = (boards.select("customFields", F.explode("cards").alias("c"))
             .select("customFields", F.col("c.id").alias("card_id"), F.explode("c.customFieldItems").alias("i")))
    fdef = F.try_element_at(F.filter("customFields", lambda f: f["id"] == F.col("i.idCustomField")), F.lit(1))
    j = items.select("card_id", F.col("i.idValue").alias("idValue"), F.col("i.value").alias("value"),
                     fdef["name"].alias("field"), fdef["type"].alias("type"), fdef["options"].alias("options"))
    opt_text = F.try_element_at(F.filter("options", lambda o: o["id"] == F.col("idValue")), F.lit(1))["value"]["text"]
    # an item with a value takes it by type; only an item without one looks up its option
    val = (F.when(F.col("value").isNotNull(),
                  F.when(F.col("type") == "checkbox", F.col("value.checked"))
                  .when(F.col("type") == "date", F.col("value.date"))
                  .when(F.col("type") == "text", F.col("value.text"))
                  .when(F.col("type") == "number", F.col("value.number")))
           .when(F.col("type") == "list", opt_text))
    return j.select("card_id", "field", val.alias("value"))


def pivot_fields(df: DataFrame, *, key: str, field: str, value: str, fields: Sequence[str],
                 agg: str = "first") -> DataFrame:
    """S2 pivot: one column per declared field (missing -> null)."""
    g = df.groupBy(key).pivot(field, list(fields))
    return g.agg(F.first(value, ignorenulls=True)) if agg == "first" else g.agg(getattr(F, agg)(value))


def field_columns(values: DataFrame, fields: Sequence[str], key: str = "card_id",
                  unused: Sequence[str] = ("spouting_done",)) -> DataFrame:
    """One column per declared field under its cleaned name; ``unused`` ones are left out."""
    from tradeflow.functions.text import clean_field_name
    wide = pivot_fields(values, key=key, field="field", value="value", fields=fields)
    names = {f: clean_field_name(f) for f in fields}
    return wide.select(key, *[F.col(f"`{f}`").alias(n) for f, n in names.items() if n not in unused])


def open_lists(boards: DataFrame) -> DataFrame:
    """S3: list lookup (open lists only) joined with the board keys."""
    return (boards.select(F.col("id").alias("board_id"), F.col("name").alias("board_name"),
                          F.explode("lists").alias("l"))
            .filter(~F.coalesce(F.col("l.closed"), F.lit(False)))
            .select("board_id", "board_name", F.col("l.id").alias("list_id"), F.col("l.name").alias("list_name")))


def field_definitions(boards: DataFrame) -> DataFrame:
    """S3: the custom fields of every board, by board and field."""
    return (boards.select(F.col("id").alias("board_id"), F.col("name").alias("board_name"), F.explode("customFields").alias("f"))
            .select("board_id", "board_name", F.col("f.id").alias("field_id"), F.col("f.name").alias("field_name"),
                    F.col("f.type").alias("field_type")).distinct())


def field_options(boards: DataFrame) -> DataFrame:
    """S3: the options of the dropdown fields of every board; fields without options have no row."""
    fields = boards.select(F.col("id").alias("board_id"), F.explode("customFields").alias("f"))
    return (fields.select("board_id", F.col("f.id").alias("field_id"), F.col("f.name").alias("field_name"), F.posexplode("f.options").alias("place", "o"))
            .select("board_id", "field_id", "field_name", F.col("o.id").alias("option_id"), F.col("o.value.text").alias("option"),
                    "place").distinct())


def board_labels(boards: DataFrame) -> DataFrame:
    """S3: the labels that the cards of every board carry, and how many cards do."""
    cards = boards.select(F.col("id").alias("board_id"), F.explode("cards").alias("c"))
    held = cards.select("board_id", F.explode(F.array_distinct(F.transform("c.labels", lambda x: x["name"]))).alias("label"))
    return held.groupBy("board_id", "label").agg(F.count(F.lit(1)).alias("n_cards"))


def checklist_items(boards: DataFrame, first_only: bool = False) -> DataFrame:
    """(card, checklist, item, state, due); empty checklists drop out.
    ``first_only`` keeps each checklist's first item (board-level variant)."""
    c = boards.select(F.explode("cards").alias("c")).select(F.col("c.id").alias("card_id"),
                                                           F.explode("c.checklists").alias("cl"))
    items = c.select("card_id", F.col("cl.name").alias("checklist"), F.posexplode("cl.checkItems").alias("pos", "it"))
    if first_only:
        items = items.filter(F.col("pos") == 0)
    return items.select("card_id", "checklist", F.col("it.name").alias("item"), F.col("it.state").alias("state"),
                        F.col("it.due").alias("due"))


# Multi-page quote JSON
LINE_ITEM = T.StructType([T.StructField("LineItemID", T.StringType()), T.StructField("ItemCode", T.StringType()),
                          T.StructField("Description", T.StringType()), T.StructField("Quantity", T.DoubleType()),
                          T.StructField("UnitAmount", T.DoubleType()), T.StructField("LineAmount", T.DoubleType())])
QUOTE = T.StructType([T.StructField("QuoteID", T.StringType()), T.StructField("QuoteNumber", T.StringType()),
                      T.StructField("Reference", T.StringType()), T.StructField("Status", T.StringType()),
                      T.StructField("DateString", T.StringType()), T.StructField("UpdatedDateUTC", T.StringType()),
                      T.StructField("Contact", T.StructType([
                          T.StructField("ContactID", T.StringType()), T.StructField("Name", T.StringType()),
                          T.StructField("EmailAddress", T.StringType())])),
                      T.StructField("LineItems", T.ArrayType(LINE_ITEM))])
QUOTE_PAGE = T.StructType([T.StructField("Quotes", T.ArrayType(QUOTE))])
_LINE_KEYS = ("ItemCode", "Description", "Quantity", "UnitAmount", "LineAmount")


def quote_lines_from_json(pages: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Page documents -> one row per line item with the quote's fields
    repeated. DELETED quotes are removed, quotes without a status stay. The
    second frame has one row per problem of a quote or line: (quote_no,
    line_id, error)."""
    from tradeflow.functions.text import pct_from_text
    q = (pages.select(F.from_json(json_col, QUOTE_PAGE).alias("p")).select(F.explode("p.Quotes").alias("q"))
         .filter(~F.col("q.Status").eqNullSafe("DELETED")))
    millis = F.regexp_extract("q.UpdatedDateUTC", r"(\d{13})", 1)
    head = q.select(
        F.col("q.QuoteNumber").alias("quote_no"), F.col("q.Reference").alias("quote_ref"),
        F.col("q.Contact.Name").alias("customer"), F.col("q.QuoteID").alias("quote_id"),
        F.col("q.Contact.ContactID").alias("contact_id"), F.col("q.Contact.EmailAddress").alias("_email"),
        F.col("q.Status").alias("quote_status"), F.to_date(F.col("q.DateString")).alias("created"),
        F.to_date(F.timestamp_millis(F.when(millis != "", millis.cast("long")))).alias("updated"),
        F.col("q.LineItems").alias("_items"))
    item = head.withColumn("li", F.explode("_items"))
    lines = item.select(
        "quote_no", "quote_ref", "customer", "quote_id", "contact_id", "quote_status", "created", "updated",
        F.round(pct_from_text("li.Description"), 2).alias("line_pct"),
        F.col("li.ItemCode").alias("item_code"), F.col("li.Description").alias("item_desc"),
        F.col("li.LineItemID").alias("line_id"), F.col("li.Quantity").alias("quantity"),
        F.col("li.UnitAmount").alias("unit_price"), F.col("li.LineAmount").alias("line_total"))
    none = F.lit(None).cast("string").alias("line_id")
    tests = {"no_line_items": F.coalesce(F.size("_items"), F.lit(0)) <= 0, "no_reference": F.col("quote_ref").isNull(),
             "no_email": F.col("_email").isNull(), "no_updated_date": F.col("updated").isNull()}
    of_quotes = head.select("quote_no", none, F.explode(F.array_compact(F.array(
        *[F.when(cond, F.lit(name)) for name, cond in tests.items()]))).alias("error"))
    of_lines = item.select("quote_no", F.col("li.LineItemID").alias("line_id"), F.explode(F.array_compact(F.array(
        *[F.when(F.col(f"li.{k}").isNull(), F.lit(f"no_{k}")) for k in _LINE_KEYS]))).alias("error"))
    return lines, of_quotes.unionByName(of_lines)


def human_lines(lines: DataFrame) -> DataFrame:
    """The lines without their technical ids."""
    return lines.drop("quote_id", "contact_id", "line_id")


def complex_to_text(df: DataFrame) -> DataFrame:
    """arrays/structs/maps -> JSON text, other columns untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)

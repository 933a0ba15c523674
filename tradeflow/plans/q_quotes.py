"""Quote family queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.functions.text import pct_from_text, zero_to_one
from tradeflow.operators import quotes as Q
from tradeflow.plans import project_flow as PF
from tradeflow.plans.fixtures import duck_cte, fixture
from tradeflow.plans.registry import register


def quote_lines_df(spark, sf_dir):
    a = Q.normalise_source_a(fixture(spark, sf_dir, "quote_src_a"))
    b = Q.normalise_source_b(fixture(spark, sf_dir, "quote_src_b"))
    return Q.union_quotes(b, a)


# DuckDB restatement of T5 + F5 + U1 + T6.
DUCK_PCT = ("round(CAST(CASE WHEN regexp_extract(item, '(\\d[0-9]*[.]\\d[0-9]{0,3}[%])|(\\d[0-9][%])', 0) = '' "
            "THEN '100' ELSE rtrim(regexp_extract(item, '(\\d[0-9]*[.]\\d[0-9]{0,3}[%])|(\\d[0-9][%])', 0), '%') "
            "END AS DOUBLE) / 100.0, 3)")

DUCK_QUOTE_LINES = f"""
fx_quote_lines AS MATERIALIZED (
  SELECT quote_no, site AS quote_ref, customer, '' AS quote_status, item AS item_desc, '' AS item_code,
         CASE WHEN {DUCK_PCT} = 0 THEN 1.0 ELSE {DUCK_PCT} END AS line_pct,
         quantity, unit_price, total AS line_total, CAST(date_created AS DATE) AS created, 'Simpro' AS quote_source
  FROM fx_quote_src_b
  UNION ALL
  SELECT quote_no, quote_ref, customer, quote_status, item_desc, item_code,
         CASE WHEN line_pct = 0 THEN 1.0 ELSE line_pct END AS line_pct,
         quantity, unit_price, line_total, CAST(created AS DATE) AS created, 'Xero' AS quote_source
  FROM fx_quote_src_a)
"""


def duck_quote_lines_cte(*more: str) -> str:
    return duck_cte("customer_titles", "quote_src_a", "quote_src_b", *more) + "," + DUCK_QUOTE_LINES


@register("quote_lines", "T5,T6,U1,F5,T4", oracle=lambda: duck_quote_lines_cte() + "SELECT * FROM fx_quote_lines",
          bench=True)
def quote_lines(spark, sf_dir):
    """Two quote sources normalised to one 12-column line table."""
    return quote_lines_df(spark, sf_dir)


@register("quote_headers", "A1", bench=True, oracle=lambda: duck_quote_lines_cte() + """
SELECT quote_no, min(quote_ref) AS quote_ref, min(customer) AS customer, min(quote_status) AS quote_status,
       min(created) AS created, min(quote_source) AS quote_source, count(*) AS n_lines,
       round(sum(line_total), 2) AS quote_value
FROM fx_quote_lines GROUP BY quote_no""")
def quote_headers(spark, sf_dir):
    return PF.quote_headers(spark, sf_dir)


@register("quote_latest_per_ref", "A2", oracle=lambda: duck_quote_lines_cte() + """,
h AS (SELECT quote_no, min(quote_ref) AS quote_ref, min(customer) AS customer, min(quote_status) AS quote_status,
             min(created) AS created, min(quote_source) AS quote_source, count(*) AS n_lines,
             round(sum(line_total), 2) AS quote_value
      FROM fx_quote_lines GROUP BY quote_no)
SELECT ref_key, quote_no, quote_ref, customer, quote_status, created, quote_source, n_lines, quote_value
FROM (SELECT *, coalesce(quote_ref, quote_no) AS ref_key,
             row_number() OVER (PARTITION BY coalesce(quote_ref, quote_no) ORDER BY created DESC, quote_no DESC) AS rn
      FROM h) WHERE rn = 1""")
def quote_latest_per_ref(spark, sf_dir):
    return PF.ref_quotes(spark, sf_dir)


@register("quote_distinct_refs", "A6", oracle=lambda: duck_quote_lines_cte() + """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_quote_lines)) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_quote_lines)) AS n_removed,
       (SELECT count(DISTINCT quote_no) FROM fx_quote_lines) AS n_quote_nos
FROM fx_quote_lines""")
def quote_distinct_refs(spark, sf_dir):
    from tradeflow.operators.aggregate import dedup_report
    return dedup_report(quote_lines_df(spark, sf_dir), distinct_keys=("quote_no",))


# The oracle's regex engine has no look-ahead: there each such pattern is one that must match and one that must not.
_WITHOUT_LOOKAHEAD = {
    "ss": ("[R,r]emove and replace.*.sewer", "[R,r]emove and replace.*stormwater"),
    "sw": ("[R,r]emove and replace.*.stormwater", "[R,r]emove and replace.*sewer"),
    "concrete": ("[R,r]emove and replace.*[C,c]oncrete", "[R,r]emove and replace.*[P,p]aver"),
    "deck": (".[d,D]eck", "[P,p]ipelining|[C,c]oncrete|[U,u]nder|[P,p]aint|CCTV|[s,S]tormwater|[s,S]ide|[L,l]abour|"
                          "[R,r]e-|[C,c]onnect|[A,a]dditional|[U,u]plift|[P,p]atch"),
    "pavers_not_in_concrete": (".pavers not|relay [P,p]avers", "Pipelining.*pavers not"),
    "pavers_in_concrete": (".pavers set", "Pipelining"),
}


def _sql_categories(cats) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for k, d, r, w in cats:
        must, not_ = _WITHOUT_LOOKAHEAD.get(k, (r, "$."))  # nothing follows the end
        rows.append(f"({quoted(k)}, {quoted(d)}, {quoted(must)}, {quoted(not_)}, {str(bool(w)).upper()})")
    return "cats(category, description, pattern, without, subs_work) AS (VALUES " + ", ".join(rows) + ")"


_ALL_CATEGORIES = """
SELECT l.quote_no, c.category, count(*) AS n_lines, round(sum(l.line_pct * l.quantity), 4) AS qty,
       c.description, c.subs_work, TRUE AS has
FROM fx_quote_lines l JOIN cats c ON regexp_matches(l.item_desc, c.pattern) AND NOT regexp_matches(l.item_desc, c.without)
GROUP BY l.quote_no, c.category, c.description, c.subs_work"""


@register("quote_categories", "A9", oracle=lambda: duck_quote_lines_cte() + "," + _sql_categories(Q.QUOTE_CATEGORIES)
          + _ALL_CATEGORIES)
def quote_categories(spark, sf_dir):
    """A9 with all 30 categories."""
    return Q.quote_category_quantities(quote_lines_df(spark, sf_dir))


@register("quote_categories_all", "A9", oracle=lambda: duck_quote_lines_cte() + "," + _sql_categories(Q.QUOTE_CATEGORIES)
          + _ALL_CATEGORIES)
def quote_categories_all(spark, sf_dir):
    """The same under its earlier name."""
    return quote_categories(spark, sf_dir)


@register("quotes_merged", "A10", oracle=lambda: duck_quote_lines_cte() + """,
h AS (SELECT quote_no, customer, round(sum(line_total), 2) AS quote_value FROM fx_quote_lines GROUP BY quote_no, customer)
SELECT customer AS project, 'various' AS quote_no, 'derived' AS quote_status, 'merged' AS quote_source,
       count(*) AS n_quotes, round(sum(quote_value), 2) AS quote_value FROM h GROUP BY customer""")
def quotes_merged(spark, sf_dir):
    """A10: the quotes of each customer merged into one."""
    h = quote_lines_df(spark, sf_dir).groupBy("quote_no", "customer").agg(F.round(F.sum("line_total"), 2).alias("quote_value"))
    return Q.merge_quotes(h.select("quote_no", "quote_value"), h.select(F.col("customer").alias("project"), "quote_no"))


@register("quote_category_lines", "A9", oracle=lambda: duck_quote_lines_cte() + "," + _sql_categories(Q.QUOTE_CATEGORIES) + """
SELECT l.quote_no, c.category, l.item_desc, round(l.line_pct * l.quantity, 4) AS line_qty
FROM fx_quote_lines l JOIN cats c ON regexp_matches(l.item_desc, c.pattern) AND NOT regexp_matches(l.item_desc, c.without)""")
def quote_category_lines(spark, sf_dir):
    """The relevant lines of each category."""
    m = Q.line_category_matrix(quote_lines_df(spark, sf_dir))
    return m.select("quote_no", "category", "item_desc", F.round("line_qty", 4).alias("line_qty"))


@register("quote_source_merge", "J8,R11", oracle=lambda: duck_quote_lines_cte() + """,
h AS (SELECT quote_source, quote_no, min(quote_ref) AS quote_ref, min(customer) AS customer,
             min(quote_status) AS quote_status, min(created) AS created, round(sum(line_total), 2) AS quote_value
      FROM fx_quote_lines GROUP BY quote_source, quote_no),
x AS (SELECT * FROM h WHERE quote_source = 'Xero'),
s AS (SELECT * FROM h WHERE quote_source = 'Simpro')
SELECT coalesce(x.quote_no, s.quote_no) AS quote_no,
       coalesce(x.quote_ref, s.quote_ref) AS quote_ref,
       coalesce(x.customer, s.customer) AS customer,
       x.quote_status AS quote_status,
       coalesce(x.created, s.created) AS created,
       coalesce(s.quote_value, x.quote_value) AS quote_value,
       CASE WHEN s.quote_no IS NULL THEN 'Xero' ELSE 'Simpro' END AS quote_source
FROM x FULL OUTER JOIN s ON x.quote_no = s.quote_no""")
def quote_source_merge(spark, sf_dir):
    """Full outer merge of the two sources' quote headers on quote_no (1:1),
    COALESCE per column, provenance 'Xero' only when the right side is missing."""
    from tradeflow.operators.joins import outer_merge
    lines = quote_lines_df(spark, sf_dir)
    h = lines.groupBy("quote_source", "quote_no").agg(
        F.min("quote_ref").alias("quote_ref"), F.min("customer").alias("customer"),
        F.min("quote_status").alias("quote_status"), F.min("created").alias("created"),
        F.round(F.sum("line_total"), 2).alias("quote_value"))
    x = h.filter(F.col("quote_source") == "Xero").drop("quote_source")
    s = h.filter(F.col("quote_source") == "Simpro").drop("quote_source")
    return outer_merge(x, s, on=["quote_no"],
                       prefer_left=["quote_ref", "customer", "created"],
                       prefer_right=["quote_value"],
                       left_only=["quote_status"],
                       tag=("quote_source", "Xero", "Simpro"))


@register("quote_lines_merged", "J8,R11", oracle=lambda: duck_cte("quote_src_a", "quote_src_b") + """,
b AS (SELECT *, """ + f"CASE WHEN {DUCK_PCT} = 0 THEN 1.0 ELSE {DUCK_PCT} END" + """ AS line_pct,
             row_number() OVER (PARTITION BY quote_no ORDER BY item, quantity, total, date_approved) AS n FROM fx_quote_src_b),
a AS (SELECT *, row_number() OVER (PARTITION BY quote_no ORDER BY line_id, item_desc, item_code, quantity, line_total, line_pct) AS n FROM fx_quote_src_a)
SELECT coalesce(a.quote_no, b.quote_no) AS quote_no, coalesce(a.n, b.n) - 1 AS occurrence, coalesce(a.quote_ref, b.site) AS quote_ref,
       coalesce(a.customer, b.customer) AS customer, a.quote_status AS quote_status, coalesce(CAST(a.created AS DATE), b.date_created) AS created,
       coalesce(a.line_pct, b.line_pct) AS line_pct, a.item_code AS item_code, coalesce(b.item, a.item_desc) AS item_desc,
       coalesce(a.quantity, b.quantity) AS quantity, coalesce(a.unit_price, b.unit_price) AS unit_price,
       coalesce(b.total, a.line_total) AS line_total, CASE WHEN b.quote_no IS NULL THEN 'Xero' ELSE 'Simpro' END AS quote_source
FROM a FULL OUTER JOIN b ON a.quote_no = b.quote_no AND a.n = b.n""")
def quote_lines_merged(spark, sf_dir):
    """J8 / R11 on lines: both sources' lines of a quote side by side, first with first, and what either has more of alone."""
    from tradeflow.operators.joins import aligned_merge
    a = fixture(spark, sf_dir, "quote_src_a")
    b = fixture(spark, sf_dir, "quote_src_b").withColumn("line_pct", zero_to_one(pct_from_text("item")))
    both = lambda x, y=None: F.coalesce(F.col(f"l.{x}"), F.col(f"r.{y or x}"))
    return aligned_merge(a, b, ["quote_no"], left_order=["line_id", "item_desc", "item_code", "quantity", "line_total", "line_pct"], right_order=["item", "quantity", "total", "date_approved"],
                         tag=("quote_source", "Xero", "Simpro"),
                         columns={"quote_ref": both("quote_ref", "site"), "customer": both("customer"), "quote_status": F.col("l.quote_status"),
                                  "created": F.coalesce(F.to_date("l.created"), F.col("r.date_created")), "line_pct": both("line_pct"),
                                  "item_code": F.col("l.item_code"), "item_desc": F.coalesce("r.item", "l.item_desc"),
                                  "quantity": both("quantity"), "unit_price": both("unit_price"),
                                  "line_total": F.coalesce("r.total", "l.line_total")})

"""Report, dashboard and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.operators import reports as R
from tradeflow.operators.aggregate import counts_with_empty, exact_median_and_mean, share_of_total
from tradeflow.plans import project_flow as PF
from tradeflow.plans.duck_flow import ctes
from tradeflow.plans.fixtures import duck_cte, fixture, tables
from tradeflow.plans.registry import register

# Named-parameter report texts over the job-card view ``job_cards``.
APPROVED_SQL = """
SELECT card_title, url, CAST(eqc_approved_date AS DATE) AS eqc_approved_date, status, accepted_quote_value,
       submitted_quote_value, quote_value, report_by
FROM {cards} WHERE eqc_approved_date IS NOT NULL
ORDER BY eqc_approved_date DESC NULLS LAST"""
DECLINED_SQL = """
SELECT card_title, url, CAST(eqc_declined_date AS DATE) AS eqc_declined_date, status, accepted_quote_value,
       submitted_quote_value, quote_value, report_by
FROM {cards} WHERE eqc_declined_date IS NOT NULL
ORDER BY eqc_declined_date DESC NULLS LAST"""


#: fields of a card that the fixture does not hold, from those it does; unsurveyed cards have no values
_CARD_FIELDS = {
    "report_by": "surveyed_by",
    "survey_completed_on": "CASE WHEN surveyed_by IS NOT NULL THEN report_sent_to_eqc END",
    "submitted_quote_value": "CASE WHEN surveyed_by IS NOT NULL THEN round(concrete_qty * 100, 2) END",
    "accepted_quote_value": "CASE WHEN eqc_approved_date IS NOT NULL THEN round(concrete_qty * 90, 2) END",
    "quote_value": "coalesce(CASE WHEN eqc_approved_date IS NOT NULL THEN round(concrete_qty * 90, 2) END, round(asphalt_qty * 100, 2))"}


def _cards(spark, sf_dir):
    return fixture(spark, sf_dir, "job_cards").withColumns({n: F.expr(x) for n, x in _CARD_FIELDS.items()})


def _duck_cards() -> str:
    fields = ", ".join(f"{x} AS {n}" for n, x in _CARD_FIELDS.items())
    return duck_cte("customer_titles", "job_cards") + f", cards AS (SELECT *, {fields} FROM fx_job_cards)\n"


@register("approved_jobs", "R1,T11,P7,O1", oracle=lambda: _duck_cards() + APPROVED_SQL.format(cards="cards"))
def approved_jobs(spark, sf_dir):
    return spark.sql(APPROVED_SQL, cards=_cards(spark, sf_dir))


@register("declined_jobs", "R2,T11,P7,O1", oracle=lambda: _duck_cards() + DECLINED_SQL.format(cards="cards"))
def declined_jobs(spark, sf_dir):
    return spark.sql(DECLINED_SQL, cards=_cards(spark, sf_dir))


AWAITING = ("Awaiting Approval", "Approved")


@register("jobs_awaiting_approval", "R3,P6,O1", oracle=lambda: _duck_cards() + f"""
SELECT card_title, url, CAST(report_sent_to_eqc AS DATE) AS sent_to_customer_date, status, report_by
FROM cards WHERE status IN {AWAITING} ORDER BY sent_to_customer_date ASC NULLS LAST""")
def jobs_awaiting_approval(spark, sf_dir):
    c = _cards(spark, sf_dir)
    return (c.filter(F.col("status").isin(*AWAITING))
            .select("card_title", "url", F.to_date("report_sent_to_eqc").alias("sent_to_customer_date"), "status",
                    "report_by")
            .orderBy(F.col("sent_to_customer_date").asc_nulls_last()))


@register("approval_time_stats", "R4,A8", oracle=lambda: _duck_cards() + """
SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY date_diff('day', report_sent_to_eqc, eqc_approved_date))
         AS median_time_difference,
       round(avg(CAST(date_diff('day', report_sent_to_eqc, eqc_approved_date) AS DOUBLE)), 2) AS mean_time_difference
FROM cards WHERE eqc_approved_date IS NOT NULL AND report_sent_to_eqc IS NOT NULL
  AND date_diff('day', report_sent_to_eqc, eqc_approved_date) > 0""")
def approval_time_stats(spark, sf_dir):
    c = _cards(spark, sf_dir)
    d = c.select(F.datediff("eqc_approved_date", "report_sent_to_eqc").alias("d")).filter(F.col("d") > 0)
    return exact_median_and_mean(d, "d", "median_time_difference", "mean_time_difference")


JOBS_BY_APPROVAL_SQL = """-- jobs of the given states approved since a date
SELECT card_title AS name, url, report_by, project_manager AS claim_manager, status, report_sent_to_eqc, eqc_approved_date,
       survey_completed_on, quote_value
FROM {cards}
WHERE array_contains({{ statuses }}, status) AND eqc_approved_date >= {{ since }}
ORDER BY report_sent_to_eqc DESC NULLS LAST"""


@register("jobs_by_approval_date", "R5,R13,R14,P6,P7", oracle=lambda: _duck_cards() + """
SELECT card_title AS name, url, report_by, project_manager AS claim_manager, status, report_sent_to_eqc, eqc_approved_date,
       survey_completed_on, quote_value
FROM cards WHERE status IN ('Approved', 'Awaiting Approval', 'Completed') AND eqc_approved_date >= DATE '2021-06-01'
ORDER BY report_sent_to_eqc DESC NULLS LAST""")
def jobs_by_approval_date(spark, sf_dir):
    """A registered template run with bound parameters (no text substitution)."""
    import datetime as dt
    reports: dict[str, R.Report] = {}
    R.register_report(reports, "jobs_by_approval_date", JOBS_BY_APPROVAL_SQL)
    df, error = R.run_report(spark, reports, "jobs_by_approval_date", {"cards": _cards(spark, sf_dir)},
                             statuses=F.array(*[F.lit(s) for s in ("Approved", "Awaiting Approval", "Completed")]),
                             since=dt.date(2021, 6, 1))
    if error:
        raise RuntimeError(error)
    return df


QUOTES_AFTER_SQL = "SELECT * FROM {quotes} WHERE quote_no > :quote_no ORDER BY quote_no ASC"


@register("quotes_after_number", "R6,P7,O1", oracle=lambda: ctes("quotes") +
          "SELECT * FROM fx_quote_lines WHERE quote_no > 'Q5000' ORDER BY quote_no")
def quotes_after_number(spark, sf_dir):
    return spark.sql(QUOTES_AFTER_SQL, args={"quote_no": "Q5000"}, quotes=PF.quote_lines(spark, sf_dir))


@register("labour_after_date", "R7,P7,O1", oracle=lambda: ctes("labour") +
          "SELECT * FROM fx_labour_raw WHERE start_date > DATE '1998-01-01' ORDER BY start_date")
def labour_after_date(spark, sf_dir):
    import datetime as dt
    rows, _ = PF.labour_hours(spark, sf_dir)
    return spark.sql("SELECT * FROM {labour} WHERE start_date > :d ORDER BY start_date",
                     args={"d": dt.date(1998, 1, 1)}, labour=rows)


@register("variation_quotes", "R9,P5", oracle=lambda: ctes("quotes") + """
SELECT * FROM fx_quote_lines
WHERE (quote_ref ILIKE '%vo%' OR quote_ref ILIKE '%variation%') AND quote_ref NOT ILIKE '%avo%'
  AND quote_ref NOT ILIKE '%vog%'""")
def variation_quotes(spark, sf_dir):
    return R.variation_quotes(PF.quote_lines(spark, sf_dir))


@register("parts_filtered", "R10,P4", oracle=lambda: """
SELECT * FROM part WHERE (p_name ILIKE '%RED%' OR p_name ILIKE '%gr__n%' OR p_name ILIKE 'a%') AND p_name NOT ILIKE '%1%'
  AND p_name NOT ILIKE '%o'""")
def parts_filtered(spark, sf_dir):
    """The pattern filter on a given table and column, with lists of matches and exceptions."""
    return R.filter_table(spark, tables(spark, sf_dir)["part"], "p_name", ["%RED%", "%gr__n%", "a%"], ["%1%", "%o"])


@register("quotes_deleted_excluded", "P8,P6", oracle=lambda: ctes("quotes") + """
SELECT quote_source, count(*) AS n FROM fx_quote_lines WHERE quote_status <> 'P' GROUP BY quote_source""")
def quotes_deleted_excluded(spark, sf_dir):
    """Status exclusion (here status 'P' stands in for DELETED), counted per source."""
    return (PF.quote_lines(spark, sf_dir).filter(F.col("quote_status") != "P")
            .groupBy("quote_source").agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------- A17 dashboards
@register("dash_hours_by_employee", "A17", oracle=lambda: ctes("labour") +
          "SELECT employee, round(sum(total_hours), 2) AS hours FROM fx_labour GROUP BY employee")
def dash_hours_by_employee(spark, sf_dir):
    rows, _ = PF.labour_hours(spark, sf_dir)
    from tradeflow.operators.jobs import filter_labour
    return filter_labour(rows)[0].groupBy("employee").agg(F.round(F.sum("total_hours"), 2).alias("hours"))


@register("dash_unit_price_by_status", "A17", oracle=lambda: ctes("quotes") +
          "SELECT quote_status, round(sum(unit_price), 2) AS unit_price FROM fx_quote_lines GROUP BY quote_status")
def dash_unit_price_by_status(spark, sf_dir):
    return (PF.quote_lines(spark, sf_dir).groupBy("quote_status")
            .agg(F.round(F.sum("unit_price"), 2).alias("unit_price")))


@register("dash_cards_by_status", "A17,P6", oracle=lambda: _duck_cards() + """
SELECT status, count(*) AS n FROM cards WHERE status NOT IN ('Completed', 'Declined', 'NFA, No Damage, PVC')
GROUP BY status""")
def dash_cards_by_status(spark, sf_dir):
    return (_cards(spark, sf_dir).filter(~F.col("status").isin("Completed", "Declined", "NFA, No Damage, PVC"))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@register("dash_costs_by_source_account", "A17", bench=True, oracle=lambda: duck_cte("customer_titles", "costs") + """
SELECT Source, Account, count(*) AS n_rows, round(sum(Gross), 2) AS gross FROM fx_costs GROUP BY Source, Account""")
def dash_costs_by_source_account(spark, sf_dir):
    return (fixture(spark, sf_dir, "costs").groupBy("Source", "Account")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("Gross"), 2).alias("gross")))


@register("dash_jobs_by_suburb_board", "A17", oracle=lambda: ctes("jobs") + """
SELECT split_part(address, ', ', 2) AS suburb, board_name, count(*) AS n FROM fx_jobs
WHERE contains(address, ',') AND status <> 'Declined' GROUP BY 1, 2""")
def dash_jobs_by_suburb_board(spark, sf_dir):
    j, _ = PF.jobs_table(spark, sf_dir)
    return (j.filter(F.col("suburb").isNotNull() & (F.col("status") != "Declined"))
            .groupBy("suburb", "board_name").agg(F.count(F.lit(1)).alias("n")))


@register("dash_source_share", "A19,DQ3", oracle=lambda: ctes("quotes") + """
SELECT quote_source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM fx_quote_lines GROUP BY quote_source""")
def dash_source_share(spark, sf_dir):
    return share_of_total(PF.quote_lines(spark, sf_dir), "quote_source")


@register("cards_per_status_incl_empty", "A18", oracle=lambda: _duck_cards() + """,
statuses AS (SELECT * FROM (VALUES ('Approved'), ('Awaiting Approval'), ('Completed'), ('Declined'),
                                   ('NFA, No Damage, PVC'), ('Archived')) v(status))
SELECT s.status, coalesce(c.n, 0) AS n FROM statuses s
LEFT JOIN (SELECT status, count(*) AS n FROM cards GROUP BY status) c ON c.status = s.status""")
def cards_per_status_incl_empty(spark, sf_dir):
    lists = spark.createDataFrame([(s,) for s in ("Approved", "Awaiting Approval", "Completed", "Declined",
                                                  "NFA, No Damage, PVC", "Archived")], "status string")
    return counts_with_empty(lists, _cards(spark, sf_dir), "status")


@register("top5_quotes", "O3", oracle=lambda: ctes("quotes") + """
SELECT quote_no, round(sum(line_total), 2) AS quote_value FROM fx_quote_lines GROUP BY quote_no
ORDER BY quote_no DESC LIMIT 5""")
def top5_quotes(spark, sf_dir):
    """Top-5 by quote number (the limit is the feature)."""
    h = PF.quote_lines(spark, sf_dir).groupBy("quote_no").agg(F.round(F.sum("line_total"), 2).alias("quote_value"))
    return R.top_k(h, 5, F.col("quote_no").desc())


@register("cards_union_boards", "U2,F15", oracle=lambda: _duck_cards() + """
SELECT short_url, card_title, board_name, 'https://www.trello.com/c/' || short_url AS card_url, NULL AS note
FROM cards WHERE board_name = 'Current Jobs'
UNION ALL
SELECT short_url, card_title, board_name, 'https://www.trello.com/c/' || short_url, 'survey'
FROM cards WHERE board_name = 'Survey Workflow'""")
def cards_union_boards(spark, sf_dir):
    """Cards of several boards with differing columns, unioned by name."""
    from tradeflow.functions.text import url_from_short_id
    c = _cards(spark, sf_dir)
    a = c.filter(F.col("board_name") == "Current Jobs").select("short_url", "card_title", "board_name")
    b = (c.filter(F.col("board_name") == "Survey Workflow").select("short_url", "card_title", "board_name")
         .withColumn("note", F.lit("survey")))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.select("short_url", "card_title", "board_name", url_from_short_id("short_url").alias("card_url"),
                    F.col("note").cast("string").alias("note"))


@register("events_pivot", "S2,A11", oracle=lambda: """
SELECT user_id,
       round(sum(CASE WHEN event_type = 'click' THEN value END), 6) AS click,
       round(sum(CASE WHEN event_type = 'error' THEN value END), 6) AS error,
       round(sum(CASE WHEN event_type = 'purchase' THEN value END), 6) AS purchase,
       round(sum(CASE WHEN event_type = 'signup' THEN value END), 6) AS signup,
       round(sum(CASE WHEN event_type = 'view' THEN value END), 6) AS view
FROM events GROUP BY user_id""")
def events_pivot(spark, sf_dir):
    """S2-style pivot: one column per declared field value (values passed, no extra scan)."""
    from tradeflow.sources.nested import pivot_fields
    e = tables(spark, sf_dir)["events"]
    out = pivot_fields(e, key="user_id", field="event_type", value="value",
                       fields=["click", "error", "purchase", "signup", "view"], agg="sum")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ["click", "error", "purchase", "signup", "view"]])


@register("cost_rows_tagged", "U3", oracle=lambda: """
SELECT 'Labour' AS cost_type, 'P' || CAST(l_partkey AS VARCHAR) AS code, l_quantity AS hours, NULL AS total
FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'Supplier', 'P' || CAST(l_partkey AS VARCHAR), NULL, floor(l_extendedprice) FROM lineitem WHERE l_returnflag <> 'R'""")
def cost_rows_tagged(spark, sf_dir):
    """Labour and supplier rows of differing columns in one table, tagged by their kind."""
    from tradeflow.operators.joins import union_tagged
    li = tables(spark, sf_dir)["lineitem"].withColumn("code", F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
    labour = li.filter("l_returnflag = 'R'").select("code", F.col("l_quantity").alias("hours"))
    supplier = li.filter("l_returnflag <> 'R'").select("code", F.floor("l_extendedprice").cast("double").alias("total"))
    return union_tagged({"Labour": labour, "Supplier": supplier}, "cost_type").select("cost_type", "code", "hours", "total")


@register("dash_jobs_by_board_status", "A17", oracle=lambda: _duck_cards() + """
SELECT board_name, status, count(*) AS n FROM cards GROUP BY board_name, status""")
def dash_jobs_by_board_status(spark, sf_dir):
    return _cards(spark, sf_dir).groupBy("board_name", "status").agg(F.count(F.lit(1)).alias("n"))


@register("dash_quote_points", "A17", oracle=lambda: ctes("mapping") + """
SELECT j.name, j.latitude, j.longitude, round(sum(m.quote_value), 2) AS quote_value
FROM fx_jobs j JOIN fx_mapping m ON m.job_name = j.name WHERE m.match_type <> 'no_match'
GROUP BY j.name, j.latitude, j.longitude""")
def dash_quote_points(spark, sf_dir):
    """Quote value of each job at its place on the map."""
    jobs = PF.jobs_once(spark, sf_dir)
    m = PF.mapping_table(spark, sf_dir, jobs).filter("match_type <> 'no_match'").select(
        F.col("job_name").alias("name"), "quote_value")
    return jobs.join(m, "name").groupBy("name", "latitude", "longitude").agg(
        F.round(F.sum("quote_value"), 2).alias("quote_value"))

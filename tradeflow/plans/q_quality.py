"""Data-quality queries (DQ1-DQ8)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tradeflow.operators import jobs as J, quality as DQ
from tradeflow.operators.snapshots import Rule, Watched, compare, take
from tradeflow.plans import project_flow as PF
from tradeflow.plans.duck_flow import ctes
from tradeflow.plans.fixtures import fixture
from tradeflow.plans.registry import register
from tradeflow.session import scratch_path, written


@register("dq_quotes", "DQ3", oracle=lambda: ctes("quotes") + """,
s AS (SELECT quote_source, count(*) AS n, count(*) FILTER (WHERE line_total < 0) AS neg,
             count(*) FILTER (WHERE line_total = 0) AS zero FROM fx_quote_lines GROUP BY quote_source),
m AS (SELECT sum(n) AS n, sum(neg) AS n_neg, sum(zero) AS n_zero, max(n) AS n_top FROM s)
SELECT 'quotes' AS "table", 'non_empty' AS "check", 'error' AS severity, n > 0 AS passed,
       CAST(n AS DOUBLE) AS observed, 1.0 AS threshold FROM m
UNION ALL SELECT 'quotes', 'negative_totals_pct', 'info', n_neg = 0, round(n_neg * 100.0 / n, 2), 0.0 FROM m
UNION ALL SELECT 'quotes', 'zero_totals_pct', 'info', n_zero = 0, round(n_zero * 100.0 / n, 2), 0.0 FROM m
UNION ALL SELECT 'quotes', 'source_skew_pct', 'warning', round(n_top * 100.0 / n, 2) <= 95,
                 round(n_top * 100.0 / n, 2), 95.0 FROM m""")
def dq_quotes(spark, sf_dir):
    return DQ.quote_checks(PF.quote_lines(spark, sf_dir))


@register("dq_job_cards", "DQ2", oracle=lambda: ctes("jobs") + """,
m AS (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(card_title, '^[0-9]')) AS n_digit,
             count(DISTINCT card_id) AS n_ids FROM fx_job_cards)
SELECT 'job_cards' AS "table", 'non_empty' AS "check", 'error' AS severity, n > 0 AS passed,
       CAST(n AS DOUBLE) AS observed, 1.0 AS threshold FROM m
UNION ALL SELECT 'job_cards', 'required_columns', 'error', TRUE, 0.0, 0.0 FROM m
UNION ALL SELECT 'job_cards', 'job_title_share_pct', 'warning', n_digit * 100.0 / n >= 50, n_digit * 100.0 / n, 50.0 FROM m
UNION ALL SELECT 'job_cards', 'duplicate_ids', 'warning', n - n_ids = 0, CAST(n - n_ids AS DOUBLE), 0.0 FROM m""")
def dq_job_cards(spark, sf_dir):
    return DQ.job_card_checks(fixture(spark, sf_dir, "job_cards"))


@register("dq_ledger_volume", "DQ8", oracle=lambda: """
SELECT 'costs' AS "table", 'min_volume' AS "check", 'warning' AS severity,
       (SELECT count(*) FROM lineitem) >= 10000 AS passed, CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS observed,
       10000.0 AS threshold""")
def dq_ledger_volume(spark, sf_dir):
    return DQ.volume_check(fixture(spark, sf_dir, "costs"), "costs")


_BUSINESS = """
SELECT 'projects' AS "table", c AS "check", 'warning' AS severity, p AS passed, CAST(o AS DOUBLE) AS observed, t AS threshold
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE total_quote_value < 0 OR supplier_costs_total < 0) AS neg,
             count(*) FILTER (WHERE total_quote_value > 10000000) AS big, count(*) FILTER (WHERE gp_margin_pct < 0) AS nm,
             count(*) FILTER (WHERE coalesce(labour_hours, 0) = 0) AS nl FROM fx_projects) x,
LATERAL (VALUES ('negative_money', neg = 0, neg, 0.0), ('quote_over_limit', big = 0, big, 10000000.0),
                ('negative_margin_pct', round(nm * 100.0 / n, 2) <= 25, round(nm * 100.0 / n, 2), 25.0),
                ('no_labour_pct', round(nl * 100.0 / n, 2) <= 80, round(nl * 100.0 / n, 2), 80.0)) v(c, p, o, t)"""
_CONSISTENCY = """
SELECT 'pipeline' AS "table", c AS "check", s AS severity, p AS passed, CAST(o AS DOUBLE) AS observed, t AS threshold
FROM (SELECT (SELECT count(*) FROM fx_job_cards) AS cards, (SELECT count(*) FROM fx_jobs) AS jobs,
             (SELECT count(DISTINCT name) FROM fx_jobs) AS names, (SELECT count(*) FROM fx_projects) AS projects,
             (SELECT count(DISTINCT job_name) FROM fx_mapping) AS mapped,
             (SELECT count(DISTINCT job_name) FROM fx_mapping WHERE match_type <> 'no_match') AS matched) x,
LATERAL (VALUES ('jobs_le_cards', 'error', jobs <= cards, jobs, CAST(NULL AS DOUBLE)),
                ('projects_le_jobs', 'error', projects <= jobs, projects, NULL),
                ('conversion_pct', 'warning', round(jobs * 100.0 / cards, 2) >= 50, round(jobs * 100.0 / cards, 2), 50.0),
                ('match_coverage_pct', 'warning', round(matched * 100.0 / mapped, 2) >= 92,
                 round(matched * 100.0 / mapped, 2), 92.0),
                ('unique_job_names', 'error', jobs = names, jobs - names, 0.0)) v(c, s, p, o, t)"""


def _consistency(spark, sf_dir, parts):
    return DQ.consistency_checks(fixture(spark, sf_dir, "job_cards"), parts.jobs, parts.mapping, parts.projects)


@register("dq_business", "DQ5", oracle=lambda: ctes("rollup") + _BUSINESS)
def dq_business(spark, sf_dir):
    return DQ.business_checks(PF.projects(spark, sf_dir))


@register("dq_consistency", "DQ4", oracle=lambda: ctes("rollup") + _CONSISTENCY)
def dq_consistency(spark, sf_dir):
    return _consistency(spark, sf_dir, PF.project_parts(spark, sf_dir))


# --------------------------------------------------------------------------- snapshots
_YESTERDAY = "1998-01-01"  # the run before: quotes and bookings made by then
_RULES = (Rule("grows", "quotes"), Rule("grows", "quotes", "Xero"), Rule("constant", "quotes", "Simpro", "warning"),
          Rule("unique", "jobs"), Rule("unique", "labour", severity="warning"), Rule("same_names", "jobs", "jobs_with_hours"),
          Rule("kept_names", "jobs", severity="warning"), Rule("not_more", "jobs", "cards"), Rule("not_before", "labour", "start_date"),
          Rule("schema", "jobs"), Rule("schema", "quotes"))


def _tables(spark, sf_dir):
    """What both runs watch, made once."""
    jobs, labour = PF.jobs_once(spark, sf_dir), PF.labour_hours(spark, sf_dir)[0]
    labour = written(labour.select("labour_id", "start_date", "name", "employee", "total_hours"), "labour-hours")
    return PF.quote_lines(spark, sf_dir), fixture(spark, sf_dir, "job_cards"), jobs, labour


def _taken(spark, sf_dir, path, until: str | None, lines, cards, jobs, labour):
    hours = PF.jobs_with_hours(spark, sf_dir, jobs=jobs, labour=J.filter_labour(labour)[0])[0]
    if until:  # the tables as they were: fewer quotes and bookings
        lines = lines.filter((F.col("created") < F.lit(until).cast("date")) | (F.col("quote_source") == "Simpro"))
        labour = labour.filter(F.col("start_date") < F.lit(until).cast("date"))
    own = {"quotes": Watched(lines, source="quote_source"), "cards": Watched(cards.select("short_url"), key="short_url"),
           "jobs": Watched(jobs.select("name", "status"), key="name"), "labour": Watched(labour.select("labour_id", "start_date"), "labour_id", dates=["start_date"]),
           "jobs_with_hours": Watched(hours.select("name"), key="name")}
    take(spark, path, own, start=dt.date(1993, 1, 1))
    return path


def _snapshot_oracle(swap: bool) -> str:
    """Each rule by plain counts; ``swap``: the earlier run is checked against the later one."""
    cut = f"created < DATE '{_YESTERDAY}'"
    old, new = ("TRUE", f"({cut} OR quote_source = 'Simpro')") if swap else (f"({cut} OR quote_source = 'Simpro')", "TRUE")
    booked = f"start_date < DATE '{_YESTERDAY}'" if swap else "TRUE"
    return ctes("labour", "jobs", "quotes") + f""",
m AS (SELECT (SELECT count(*) FROM fx_quote_lines WHERE {old}) AS q0, (SELECT count(*) FROM fx_quote_lines WHERE {new}) AS q1,
             (SELECT count(*) FROM fx_quote_lines WHERE quote_source = 'Xero' AND {old}) AS x0,
             (SELECT count(*) FROM fx_quote_lines WHERE quote_source = 'Xero' AND {new}) AS x1,
             (SELECT count(*) FROM fx_quote_lines WHERE quote_source = 'Simpro') AS s,
             (SELECT count(*) - count(DISTINCT name) FROM fx_jobs) AS j,
             (SELECT count(*) - count(DISTINCT labour_id) FROM fx_labour_raw WHERE {booked}) AS l,
             (SELECT count(*) FROM fx_jobs) AS nj, (SELECT count(*) FROM fx_job_cards) AS nc,
             (SELECT count(*) FROM fx_labour_raw WHERE {booked} AND start_date < DATE '1993-01-01') AS early)
SELECT "table", "check", severity, passed, CAST(observed AS DOUBLE) AS observed, CAST(threshold AS DOUBLE) AS threshold
FROM m, LATERAL (VALUES ('quotes', 'grows', 'error', q1 >= q0, q1, q0), ('quotes', 'grows:Xero', 'error', x1 >= x0, x1, x0),
  ('quotes', 'constant:Simpro', 'warning', TRUE, s, s), ('jobs', 'unique', 'error', j = 0, j, 0), ('labour', 'unique', 'warning', l = 0, l, 0),
  ('jobs', 'same_names:jobs_with_hours', 'error', TRUE, 0, 0), ('jobs', 'kept_names', 'warning', TRUE, 0, 0),
  ('jobs', 'not_more:cards', 'error', nj <= nc, nj, nc), ('labour', 'not_before:start_date', 'error', early = 0, early, 0),
  ('jobs', 'schema', 'error', TRUE, NULL, NULL), ('quotes', 'schema', 'error', TRUE, NULL, NULL)
  ) v("table", "check", severity, passed, observed, threshold)"""


@register("dq_snapshots", "DQ7", oracle=lambda: _snapshot_oracle(False))
def dq_snapshots(spark, sf_dir):
    """DQ7: the tables as of a date stored, the tables of today stored, and the documented rules between them."""
    made = _tables(spark, sf_dir)
    before, now = (_taken(spark, sf_dir, scratch_path(spark, f"snapshot-{n}"), u, *made) for n, u in (("before", _YESTERDAY), ("now", None)))
    return compare(spark, before, now, _RULES)


@register("dq_snapshots_shrunk", "DQ7", oracle=lambda: _snapshot_oracle(True))
def dq_snapshots_shrunk(spark, sf_dir):
    """DQ7: the same runs the other way round, as after a lost export: the volume rules fail."""
    made = _tables(spark, sf_dir)
    before, now = (_taken(spark, sf_dir, scratch_path(spark, f"snapshot-{n}"), u, *made) for n, u in (("before", None), ("now", _YESTERDAY)))
    return compare(spark, before, now, _RULES)


@register("dq_customer_overlap", "DQ4", oracle=lambda: """
WITH c AS (SELECT DISTINCT c_name AS name FROM customer),
q AS (SELECT DISTINCT c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT (SELECT count(*) FROM c) AS n_cards, (SELECT count(*) FROM q) AS n_quotes,
       (SELECT count(*) FROM c JOIN q USING (name)) AS n_both""")
def dq_customer_overlap(spark, sf_dir):
    """Customers known to the cards, to the quotes, and to both."""
    return DQ.key_overlap(fixture(spark, sf_dir, "job_cards").select("customer_name"), PF.quote_lines(spark, sf_dir)
                          .select("customer"), "customer_name", "customer", ("n_cards", "n_quotes", "n_both"))


def _schema_check(spark, sf_dir):
    from pyspark.sql import types as T
    cards = fixture(spark, sf_dir, "job_cards").select("card_id", "card_title", "status")
    expected = T.StructType([T.StructField("card_id", T.StringType()), T.StructField("card_title", T.StringType()),
                             T.StructField("due", T.StringType())])
    return DQ.schema_check(cards, "job_cards", expected)


_SCHEMA = """
SELECT 'job_cards' AS "table", c AS "check", s AS severity, FALSE AS passed, CAST(NULL AS DOUBLE) AS observed,
       CAST(NULL AS DOUBLE) AS threshold
FROM (VALUES ('type:card_id', 'warning'), ('missing:due', 'error'), ('unexpected:status', 'warning')) v(c, s)
WHERE (SELECT count(*) FROM customer) >= 0"""


@register("dq_schema", "DQ1", oracle=lambda: _SCHEMA)
def dq_schema(spark, sf_dir):
    """Against an expected schema with another id type, a missing and an extra column."""
    return _schema_check(spark, sf_dir)


_SUITE = f"SELECT * FROM ({_SCHEMA}) UNION ALL SELECT * FROM ({_BUSINESS}) UNION ALL SELECT * FROM ({_CONSISTENCY})"


def _suite(spark, sf_dir):
    """Schema, business and consistency checks; two of them read the projects, which are written once."""
    parts = PF.project_parts(spark, sf_dir)
    parts = parts._replace(projects=written(parts.projects, "projects"))
    return DQ.suite(_schema_check(spark, sf_dir), DQ.business_checks(parts.projects), _consistency(spark, sf_dir, parts))


@register("dq_suite", "DQ6", oracle=lambda: ctes("rollup") + _SUITE)
def dq_suite(spark, sf_dir):
    """Schema, business and consistency checks in one table."""
    return _suite(spark, sf_dir)[0]


@register("dq_summary", "DQ6", oracle=lambda: ctes("rollup") + f"""
SELECT count(*) FILTER (WHERE NOT passed AND severity = 'error') AS n_errors,
       count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS n_warnings, count(*) AS n_checks,
       count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS passed FROM ({_SUITE})""")
def dq_summary(spark, sf_dir):
    return _suite(spark, sf_dir)[1]

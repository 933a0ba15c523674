"""Job, labour, linkage, grouping and project queries (the reference's core table graph)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeflow.operators import finance, graph, jobs as J
from tradeflow.operators.aggregate import hours_per_person, labour_per_key
from tradeflow.plans import project_flow as PF
from tradeflow.plans.duck_flow import ctes, duck_clean_address
from tradeflow.plans.fixtures import duck_cte, fixture, table_rows
from tradeflow.plans.registry import register
from tradeflow.session import dealt, lookup, written


@register("cards_removed", "P1,J5", oracle=lambda: ctes("jobs") +
          "SELECT short_url, card_title, reason FROM fx_cards_removed")
def cards_removed(spark, sf_dir):
    _, removed = J.split_cards(fixture(spark, sf_dir, "job_cards"))
    return removed.select("short_url", "card_title", "reason")


@register("jobs", "T10,F1,F10,F13,X6", oracle=lambda: ctes("jobs") + """
SELECT name, short_url, card_id, shared_drains,
       CASE WHEN contains(address, ',') THEN split_part(address, ', ', 2) END AS suburb, status, board_name
FROM fx_jobs""")
def jobs(spark, sf_dir):
    j, _ = PF.jobs_table(spark, sf_dir)
    return j.select("name", "short_url", "card_id", "shared_drains", "suburb", "status", "board_name")


@register("job_quote_mapping", "J2,J3,P9,A2", bench=True, oracle=lambda: ctes("mapping") +
          "SELECT job_name, job_no, quote_no, quote_ref, match_type, quote_value FROM fx_mapping")
def job_quote_mapping(spark, sf_dir):
    """Word-boundary phrase join of job names into quote references (token-blocked)."""
    return PF.mapping_table(spark, sf_dir)


@register("labour_hours", "S5,J1,F8,F9", oracle=lambda: ctes("labour") +
          "SELECT labour_id, name, start_date, end_date, employee, daily_hours, num_days, total_hours FROM fx_labour_raw")
def labour_hours(spark, sf_dir):
    rows, _ = PF.labour_hours(spark, sf_dir)
    return rows


@register("labour_unknown_people", "J1,K4", oracle=lambda: ctes("labour") + """
SELECT tp.task_id, tp.pid AS unknown_person_id, 'unknown_person' AS reason
FROM fx_task_people tp WHERE tp.pid NOT IN (SELECT people_id FROM fx_people)""")
def labour_unknown_people(spark, sf_dir):
    _, rej = PF.labour_hours(spark, sf_dir)
    return rej.select("task_id", "unknown_person_id", "reason")


@register("labour_cleaned", "P3,F1,D1", oracle=lambda: ctes("labour") +
          "SELECT labour_id, name, employee, total_hours FROM fx_labour")
def labour_cleaned(spark, sf_dir):
    rows, _ = PF.labour_hours(spark, sf_dir)
    kept, _ = J.filter_labour(rows)
    return kept.select("labour_id", "name", "employee", "total_hours")


_EXCLUDED = ("Supplier#000000001", "Supplier#000000003")


@register("labour_rejected", "P3,K4", oracle=lambda: ctes("labour") + f"""
SELECT labour_id, employee, 'excluded_employee' AS reason FROM fx_labour_raw WHERE employee IN {_EXCLUDED}""")
def labour_rejected(spark, sf_dir):
    """P3 with an exclusion list: what it turns away, with the reason."""
    rows, _ = PF.labour_hours(spark, sf_dir)
    return J.filter_labour(rows, excluded=_EXCLUDED)[1].select("labour_id", "employee", "reason")


@register("jobs_with_hours", "J6,A3,D2", bench=True, oracle=lambda: ctes("jobs", "labour") + """
SELECT j.name, j.short_url, h.labour_hours, h.n_site_staff, h.n_labour_records
FROM fx_jobs j LEFT JOIN fx_job_hours h ON h.name = j.name""")
def jobs_with_hours(spark, sf_dir):
    jh, _ = PF.jobs_with_hours(spark, sf_dir)
    return jh.select("name", "short_url", "labour_hours", "n_site_staff", "n_labour_records")


@register("jobs_without_hours", "J6,K4", oracle=lambda: ctes("jobs", "labour") + """
SELECT j.name, j.short_url FROM fx_jobs j WHERE j.name NOT IN (SELECT name FROM fx_job_hours)""")
def jobs_without_hours(spark, sf_dir):
    _, gap = PF.jobs_with_hours(spark, sf_dir)
    return gap.select("name", "short_url")


@register("hours_per_employee", "A4,D3", oracle=lambda: ctes("labour") + """
SELECT name, employee, round(sum(total_hours), 2) AS hours FROM fx_labour GROUP BY name, employee""")
def hours_per_employee(spark, sf_dir):
    kept = J.filter_labour(PF.labour_hours(spark, sf_dir)[0])[0]
    return hours_per_person(dealt(kept, table_rows(spark, sf_dir, "lineitem"), "name", "employee"))


@register("attachment_classes", "F11,F12", oracle=lambda: ctes("groups") + r"""
SELECT name, url, kind FROM (
  SELECT name, url, CASE
    WHEN host = 'trello.com' THEN CASE
      WHEN regexp_matches(path, '(\.jpg|\.jpeg|\.JPG|\.png|\.PNG|\.HEIC|\.heic)$') THEN 'pictures'
      WHEN regexp_matches(path, '(\.pdf|\.PDF|\.doc|\.docx|\.xls|\.xlsx)$') THEN 'documents'
      WHEN regexp_matches(path, '(\.zip|\.rar)$') THEN 'archives'
      WHEN regexp_matches(path, '(\.eml|\.html)$') THEN 'emails'
      WHEN path LIKE '%noname' THEN NULL
      WHEN regexp_matches(path, '(\.mp4|\.mov|\.gif)$') THEN 'videos'
      WHEN split_part(path, '/', 2) = 'c' THEN 'linked_cards' ELSE 'other_links' END
    WHEN url LIKE '%?usp=drive_link' THEN NULL
    WHEN host = 'drive.google.com' THEN 'drive_folder' WHEN host = 'docs.google.com' THEN 'documents'
    WHEN host = 'mail.google.com' THEN 'emails' WHEN host = 'go.xero.com' THEN 'financials' ELSE 'other_links' END AS kind
  FROM fx_att2) WHERE kind IS NOT NULL""")
def attachment_classes(spark, sf_dir):
    j, _ = PF.jobs_table(spark, sf_dir)
    return J.attachment_links(j).select("name", "url", "kind")


@register("project_members", "X1,X2,X4,X5,J10", oracle=lambda: ctes("groups") +
          "SELECT project, name, shared_drains FROM fx_members")
def project_members(spark, sf_dir):
    """Greedy one-hop shared-drain groups (parity with the sequential scan) + standalone jobs."""
    return PF.members_table(PF.jobs_once(spark, sf_dir))


@register("link_components", "X3", oracle=lambda: ctes("groups") + """,
und AS (SELECT src AS a, dst AS b FROM fx_edges UNION SELECT dst, src FROM fx_edges),
reach AS (
  WITH RECURSIVE r(node, lab) AS (
    SELECT name, name FROM fx_jobs
    UNION
    SELECT u.b, r.lab FROM r JOIN und u ON u.a = r.node)
  SELECT node, min(lab) AS component FROM r GROUP BY node)
SELECT node AS name, component FROM reach""")
def link_components(spark, sf_dir):
    """Transitive groups: connected components of the job link graph."""
    j, _ = PF.jobs_table(spark, sf_dir)
    edges, _ = PF.link_edges(j)
    return graph.connected_components(j.select("name"), edges)


@register("customers", "A5", oracle=lambda: duck_cte("customer_titles", "job_cards") + """
SELECT customer_name AS name, arg_min(customer_email, card_id) AS email, count(*) AS n_jobs,
       arg_min(card_title, card_id) AS first_job
FROM fx_job_cards GROUP BY customer_name""")
def customers(spark, sf_dir):
    return J.customers(fixture(spark, sf_dir, "job_cards"))


@register("projects", "M1,M2,M3,M4,M5,M6,M7,M8,M9,J4,A11,A12,A16", bench=True,
          oracle=lambda: ctes("rollup") + "SELECT * FROM fx_projects")
def projects(spark, sf_dir):
    """Flagship: project financials over linked quotes, labour and costs."""
    return PF.projects(spark, sf_dir)


# ---------------------------------------------------------------------------
# Item budget (M10, J7, A7) on a price book derived from part / lineitem:
# sales item = part; build-up rows = lines (returned lines are labour hours,
# others supplier costs per unit). Whole-dollar / whole-hour inputs keep the
# sums exact, so both engines see bit-identical ratios.
SALES_SQL = ("SELECT 'P' || CAST(p_partkey AS STRING) AS code, p_name AS name, "
             "CAST(CASE WHEN p_size = 1 THEN 0 ELSE floor(p_retailprice) END AS DOUBLE) AS sale_price, p_type AS Unit FROM {part} "
             # services have no build-up
             "UNION ALL SELECT 'S' || CAST(p_partkey AS STRING), p_name, CAST(floor(p_retailprice) AS DOUBLE), 'SERVICE' "
             "FROM {part} WHERE p_size = 2")
CALCS_SQL = ("SELECT 'P' || CAST(l_partkey AS STRING) AS xero_code, "
             "CASE WHEN l_returnflag = 'R' THEN 'Labour' ELSE 'Supplier' END AS cost_type, "
             "l_quantity AS amount, CAST(floor(l_extendedprice / l_quantity / 10.0) AS DOUBLE) AS total FROM {lineitem}")


def _budget_inputs(spark, sf_dir):
    from tradeflow.plans.fixtures import tables
    t = tables(spark, sf_dir)
    return spark.sql(SALES_SQL, part=t["part"]), spark.sql(CALCS_SQL, lineitem=t["lineitem"])


@register("items_budget", "M10,J7,A7", oracle=lambda: (
    "WITH s AS (" + SALES_SQL.format(part="part") + "), c AS (" + CALCS_SQL.format(lineitem="lineitem") + "),\n"
    """agg AS (SELECT xero_code, sum(CASE WHEN cost_type = 'Labour' THEN amount ELSE 0 END) AS total_labour_hours,
                  sum(CASE WHEN cost_type = 'Supplier' THEN total ELSE 0 END) AS total_supplier_costs
           FROM c GROUP BY xero_code)
SELECT s.code, s.name, s.sale_price, s.Unit, round(a.total_labour_hours, 4) AS labour_hours_per_unit,
       round(a.total_labour_hours * 50, 2) AS labour_cost_per_unit,
       round(a.total_supplier_costs, 2) AS supplier_costs_per_unit,
       round(a.total_labour_hours * 50 + a.total_supplier_costs, 2) AS cost_per_unit,
       round(s.sale_price - (a.total_labour_hours * 50 + a.total_supplier_costs), 2) AS margin,
       round((a.total_labour_hours * 50 + a.total_supplier_costs) / nullif(s.sale_price, 0), 4) AS cost_pct,
       round((s.sale_price - (a.total_labour_hours * 50 + a.total_supplier_costs)) / nullif(s.sale_price, 0), 4) AS margin_pct
FROM s LEFT JOIN agg a ON s.code = a.xero_code"""))
def items_budget(spark, sf_dir):
    sales, calcs = _budget_inputs(spark, sf_dir)
    b = finance.item_budget(sales, calcs)
    return b.select("code", "name", "sale_price", "Unit",
                    F.round("labour_hours_per_unit", 4).alias("labour_hours_per_unit"),
                    F.round("labour_cost_per_unit", 2).alias("labour_cost_per_unit"),
                    F.round("supplier_costs_per_unit", 2).alias("supplier_costs_per_unit"),
                    F.round("cost_per_unit", 2).alias("cost_per_unit"),
                    F.round("margin", 2).alias("margin"),
                    F.round("cost_pct", 4).alias("cost_pct"),
                    F.round("margin_pct", 4).alias("margin_pct"))


@register("jobs_malformed", "P2,F1", oracle=lambda: ctes("jobs") + r"""
SELECT short_url, reason, CASE WHEN reason IS NULL THEN jp END AS job,
       CASE WHEN reason IS NULL THEN trim(split_part(card_title, ',', 2)) END AS suburb
FROM (SELECT short_url, card_title, jp,
             CASE WHEN contains(card_title, 'Duplicate') OR contains(card_title, 'DUPLICATE')
                       OR contains(card_title, 'duplicate') OR contains(card_title, 'DUP')
                       OR contains(card_title, 'dup') OR contains(card_title, 'Dup') THEN 'duplicate'
                  WHEN len(string_split(card_title, ',')) - 1 > 1 THEN 'more_than_one_comma'
                  WHEN NOT regexp_matches(jp, '^\d{1,5}\D{1,2}') THEN 'malformed_job_name' END AS reason
      FROM (SELECT *, """ + duck_clean_address("split_part(card_title, ',', 1)") + """ AS jp FROM fx_job_cards))""")
def jobs_malformed(spark, sf_dir):
    """Malformed-row split of addresses with reasons; kept rows get job / suburb."""
    cards = fixture(spark, sf_dir, "job_cards")
    return J.split_malformed_addresses(cards, address="card_title").select("short_url", "reason", "job", "suburb")


@register("job_structs_flat", "T9,T10,O2", oracle=lambda: ctes("jobs") + """
SELECT name, labels, concrete_qty AS c_concrete_qty, asphalt_qty AS c_asphalt_qty, customer_name AS cust_name
FROM fx_jobs ORDER BY labels, name""")
def job_structs_flat(spark, sf_dir):
    """T10 build structs from flat card columns, T9 spread them back, O2 order by an array."""
    j, _ = PF.jobs_table(spark, sf_dir)
    s = J.build_job_structs(j, {"qty_from_card": {"c_concrete_qty": "concrete_qty", "c_asphalt_qty": "asphalt_qty"},
                                "customer_details": {"cust_name": "customer_name"}})
    flat = J.flatten_structs(s.select("name", "labels", "qty_from_card", "customer_details"),
                             "qty_from_card", "customer_details")
    return flat.select("name", "labels", "c_concrete_qty", "c_asphalt_qty", "cust_name").orderBy("labels", "name")


@register("cost_links", "J4", bench=True, oracle=lambda: ctes("rollup") + "SELECT project, row_id FROM fx_cost_pref")
def cost_links(spark, sf_dir):
    """Any-substring link of ledger rows to projects (by keys of whole needles), exact-name preference."""
    from tradeflow.operators.link import prefer_exact
    from tradeflow.session import tasks_for
    members = written(PF.members_table(PF.jobs_once(spark, sf_dir)), "members")  # read by both needle branches
    costs = written(fixture(spark, sf_dir, "costs").select("row_id", "Project", "Description"), "costs")
    links = finance.link_rows_to_projects(finance.project_needles(members), costs, row_id="row_id",
                                          text_cols=["Project", "Description"], stored=True,
                                          tasks=tasks_for(spark, table_rows(spark, sf_dir, "lineitem")))
    withp = links.join(costs.select("row_id", F.col("Project").alias("_cp")), "row_id")
    return prefer_exact(withp, group="project", exact=F.col("_cp") == F.col("project")).select("project", "row_id")


def _members(spark, sf_dir):
    j = PF.jobs_once(spark, sf_dir)
    return j, PF.members_table(j)


@register("project_statuses", "A14,M9", oracle=lambda: ctes("groups") + """
SELECT DISTINCT m.project, j.status FROM fx_members m JOIN fx_jobs j ON j.name = m.name WHERE j.status IS NOT NULL""")
def project_statuses(spark, sf_dir):
    """The set of member statuses, as bridge rows."""
    from tradeflow.operators.aggregate import distinct_values
    j, m = _members(spark, sf_dir)
    return distinct_values(m.select("project", "name").join(j.select("name", "status"), "name"), "project", "status")


@register("project_job_ids", "A14,M9", oracle=lambda: ctes("groups") + """
SELECT DISTINCT m.project, j.card_id, j.url FROM fx_members m JOIN fx_jobs j ON j.name = m.name""")
def project_job_ids(spark, sf_dir):
    """Job ids and card addresses of each project, as bridge rows."""
    j, m = _members(spark, sf_dir)
    return m.select("project", "name").join(j.select("name", "card_id", "url"), "name").select(
        "project", "card_id", "url").distinct()


@register("project_quotes", "A14,M9", oracle=lambda: ctes("rollup") + """
SELECT DISTINCT m.project, q.quote_no, q.match_type FROM fx_members m JOIN fx_mapping q ON q.job_name = m.name
WHERE q.match_type IN ('primary', 'variation')""")
def project_quotes(spark, sf_dir):
    """Quote numbers and variation quote numbers of each project, as bridge rows."""
    j, m = _members(spark, sf_dir)
    mapping = PF.mapping_table(spark, sf_dir, j).filter(F.col("match_type").isin("primary", "variation"))
    return m.select("project", F.col("name").alias("job_name")).join(mapping, "job_name").select(
        "project", "quote_no", "match_type").distinct()


@register("project_staff", "A14,M9", oracle=lambda: ctes("rollup") + """
SELECT DISTINCT m.project, l.employee FROM fx_members m JOIN fx_labour l ON l.name = m.name""")
def project_staff(spark, sf_dir):
    """Site staff of each project, as bridge rows."""
    from tradeflow.operators.aggregate import distinct_values
    _, m = _members(spark, sf_dir)
    labour = J.filter_labour(PF.labour_hours(spark, sf_dir)[0])[0]
    members = lookup(m.select("project", "name"), table_rows(spark, sf_dir, "customer"))
    staff = labour.select("name", "employee").join(members, "name").select("project", "employee")
    return distinct_values(dealt(staff, table_rows(spark, sf_dir, "lineitem"), "project", "employee"), "project", "employee")


@register("project_job_details", "A15,M9", oracle=lambda: ctes("groups") + """
SELECT m.project, j.name, j.customer_name, j.customer_email, j.concrete_qty, j.asphalt_qty, j.eqc_approved_date,
       j.report_sent_to_eqc FROM fx_members m JOIN fx_jobs j ON j.name = m.name""")
def project_job_details(spark, sf_dir):
    """Per member job its customer, quantities and timeline, as (project, job) rows."""
    j, m = _members(spark, sf_dir)
    return m.select("project", "name").join(j, "name").select(
        "project", "name", "customer_name", "customer_email", "concrete_qty", "asphalt_qty", "eqc_approved_date",
        "report_sent_to_eqc")


@register("project_booking_date", "A13,M9", oracle=lambda: ctes("groups") + """
SELECT m.project, arg_max(j.report_sent_to_eqc, j.name) FILTER (WHERE j.report_sent_to_eqc IS NOT NULL) AS booking_date
FROM fx_members m JOIN fx_jobs j ON j.name = m.name GROUP BY m.project""")
def project_booking_date(spark, sf_dir):
    """The last date known among a project's jobs, in member order."""
    from tradeflow.operators.aggregate import last_seen_per_key
    j, m = _members(spark, sf_dir)
    rows = m.select("project", "name").join(j.select("name", "report_sent_to_eqc"), "name")
    return last_seen_per_key(rows, "project", "name", "report_sent_to_eqc", "booking_date")


@register("customer_job_list", "A5", oracle=lambda: duck_cte("customer_titles", "job_cards") + """
SELECT customer_name AS name, card_title AS job_name, card_id,
       CAST(row_number() OVER (PARTITION BY customer_name ORDER BY card_id, card_title) AS INTEGER) AS pos FROM fx_job_cards""")
def customer_job_list(spark, sf_dir):
    """The ordered jobs of each customer, as bridge rows."""
    return J.customer_jobs(fixture(spark, sf_dir, "job_cards"))


# a customer's goods of one day and state: several lines give equal rows
_LEDGER = """SELECT o_custkey AS customer, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey"""


@register("ledger_distinct", "A6", oracle=lambda: f"""
SELECT DISTINCT * FROM ({_LEDGER.format(lineitem='lineitem', orders='orders')})""")
def ledger_distinct(spark, sf_dir):
    """Exact duplicates collapse."""
    return _ledger_sides(spark, sf_dir)[0]


@register("ledger_duplicates", "A6,K4", oracle=lambda: f"""
SELECT customer, day, flag FROM (SELECT *, row_number() OVER (PARTITION BY customer, day, flag) AS n
FROM ({_LEDGER.format(lineitem='lineitem', orders='orders')})) WHERE n > 1""")
def ledger_duplicates(spark, sf_dir):
    """The surplus copies, one row each."""
    return _ledger_sides(spark, sf_dir)[1]


def _ledger_sides(spark, sf_dir):
    from tradeflow.operators.aggregate import drop_exact_duplicates
    from tradeflow.plans.fixtures import tables
    t = tables(spark, sf_dir)
    return drop_exact_duplicates(spark.sql(_LEDGER, lineitem=t["lineitem"], orders=t["orders"]))


@register("projects_formatted", "R8,A14", oracle=lambda: ctes("rollup") + """
SELECT p.*, s.statuses FROM fx_projects p LEFT JOIN (
  SELECT m.project, list_sort(list(DISTINCT j.status)) AS statuses
  FROM fx_members m JOIN fx_jobs j ON j.name = m.name WHERE j.status IS NOT NULL GROUP BY m.project) s ON s.project = p.project
ORDER BY s.statuses""")
def projects_formatted(spark, sf_dir):
    """The projects with their statuses, ordered by them (as many elements as there are states of a card)."""
    parts = PF.project_parts(spark, sf_dir)
    j, m = parts.jobs, parts.members
    statuses = (m.select("project", "name").join(j.select("name", "status"), "name").filter("status IS NOT NULL")
                .groupBy("project").agg(F.array_sort(F.collect_set("status")).alias("statuses")))
    # written before the sort, which reads its rows twice: for the ranges of its tasks, then for the tasks
    return written(parts.projects.join(statuses, "project", "left"), "projects").orderBy("statuses")

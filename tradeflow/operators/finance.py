"""Project financials and item budgets.

The project roll-up works on bridge tables — (project, job), (job, quote),
(project, cost row), (project, labour row) — and folds each into one row
per project with partial aggregates, then joins the per-project results
(all keyed by project, so every join is one-to-one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeflow.functions.text import clean_multi_address
from tradeflow.operators.link import contains_join, prefer_exact

# Fixed values that must equal the reference for equal results.
LABOUR_RATE = 50.00
OVERHEAD_PCT = 0.12


def project_needles(members: DataFrame, *, project: str = "project", job: str = "name",
                    with_raw_name: bool = True) -> DataFrame:
    """(project, needle) pairs for J4: every member job name, plus the
    'raw name' — F2 of the first member (by name) for multi-job projects, else
    the job name itself."""
    base = members.select(project, F.col(job).alias("needle"))
    if not with_raw_name:
        return base.distinct()
    first = members.groupBy(project).agg(F.min(job).alias("_first"), F.count(F.lit(1)).alias("_n"))
    raw = first.select(project, F.when(F.col("_n") > 1, clean_multi_address("_first"))
                       .otherwise(F.col("_first")).alias("needle"))
    return base.unionByName(raw).distinct()


def link_rows_to_projects(needles: DataFrame, rows: DataFrame, *, row_id: str, text_cols: list[str],
                          project: str = "project", stored: bool = False, tasks: int = 0) -> DataFrame:
    """J4 at project level: (project, row_id) where any of the row's text columns
    contains any needle of the project; ``stored``: the rows are cheap to read again; ``tasks``:
    the links are dealt by row over so many, where they then meet the rows."""
    texts = None
    for c in text_cols:
        part = rows.select(F.col(row_id).alias("_rid"), F.col(c).alias("_txt"))
        texts = part if texts is None else texts.unionByName(part)
    return contains_join(needles.select(project, "needle"), texts, needle_id=project, needle_col="needle",
                         text_id="_rid", text_col="_txt", stored=stored, tasks=tasks).withColumnRenamed("_rid", row_id)


def project_rollup(members: DataFrame, jobs: DataFrame, mapping: DataFrame, quote_values: DataFrame,
                   cost_links: DataFrame, costs: DataFrame, labour_links: DataFrame, labour: DataFrame,
                   job_hours: DataFrame, *, cost_row_id: str = "row_id", labour_row_id: str = "labour_id",
                   gross: str = "Gross", cost_project_col: str = "Project") -> DataFrame:
    """M1-M9: one row per project.

    members(project, name, shared_drains); jobs(name, ...attributes);
    mapping(job_name, quote_no, match_type); quote_values(quote_no, value_raw);
    cost_links(project, row_id) before exact-preference; costs(row_id, Gross, Project);
    labour_links(project, labour_id); labour(labour_id, start_date, end_date);
    job_hours(name, labour_hours).
    """
    m = members.select("project", "name", "shared_drains")

    # people/first-non-null columns in member order (members sorted by name) — A12, A13, A16
    attrs = m.join(jobs.drop("shared_drains"), "name", "left")
    people = ["project_manager", "surveyed_by"]
    per_proj = attrs.groupBy("project").agg(
        F.max("shared_drains").alias("shared_drains"),
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_distinct("status").alias("n_statuses"),
        *[F.expr(f"min_by({c}, name) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in people],
        F.round(F.avg("longitude"), 2).alias("longitude"),
        F.round(F.avg("latitude"), 2).alias("latitude"),
        F.round(F.sum("concrete_qty"), 2).alias("sum_concrete_qty"),
        F.round(F.sum("asphalt_qty"), 2).alias("sum_asphalt_qty"),
    )

    # M2 labour hours from jobs_with_hours (sum over members, nulls skipped)
    hours = m.join(job_hours.select("name", "labour_hours"), "name", "left").groupBy("project").agg(
        F.round(F.coalesce(F.sum("labour_hours"), F.lit(0.0)), 2).alias("labour_hours"))

    # M1 quote value: 0 without a primary quote; else all (primary + variation)
    # member quotes, counted once per (member job, quote) pair (Q9 parity)
    mq = (m.join(mapping.filter(F.col("match_type").isin("primary", "variation"))
                 .select(F.col("job_name").alias("name"), "quote_no", "match_type"), "name")
          .join(quote_values, "quote_no"))
    qv = mq.groupBy("project").agg(
        F.max((F.col("match_type") == "primary").cast("int")).alias("_has_primary"),
        F.sum("value_raw").alias("_value_raw"),
        F.count(F.lit(1)).alias("n_quote_links"))
    qv = qv.select("project", "n_quote_links",
                   F.when(F.col("_has_primary") == 1, F.round("_value_raw", 2)).otherwise(F.lit(0.0))
                   .alias("total_quote_value"))

    # M3 supplier costs over J4-linked rows with exact-name preference
    cl = cost_links.join(costs.select(F.col(cost_row_id), F.col(gross).alias("_gross"),
                                      F.col(cost_project_col).alias("_cp")), cost_row_id)
    # summed per project and exactness first: the preference is among two rows of a project, not among its links
    same = F.coalesce(F.col("_cp") == F.col("project"), F.lit(False)).alias("_same")
    cl = cl.groupBy("project", same).agg(F.sum("_gross").alias("_gross"), F.count(F.lit(1)).alias("_rows"))
    cl = prefer_exact(cl, group="project", exact="_same")
    sc = cl.groupBy("project").agg(F.round(F.sum("_gross"), 2).alias("supplier_costs_total"),
                                   F.sum("_rows").alias("n_cost_rows"))

    # M7 work start / end over J4-linked labour rows
    ll = labour_links.join(labour.select(labour_row_id, "start_date", "end_date"), labour_row_id)
    we = ll.groupBy("project").agg(F.min("start_date").alias("work_start"), F.max("end_date").alias("work_end"))

    out = (per_proj.join(hours, "project", "left").join(qv, "project", "left")
           .join(sc, "project", "left").join(we, "project", "left"))
    value = F.coalesce(F.col("total_quote_value"), F.lit(0.0))
    labour_cost = F.round(F.col("labour_hours") * F.lit(LABOUR_RATE), 2)
    supplier = F.coalesce(F.col("supplier_costs_total"), F.lit(0.0))
    total_costs = F.round(supplier + labour_cost, 2)
    gp = F.round(value - total_costs, 2)
    return out.select(
        "project", "shared_drains", "n_jobs", "n_statuses", *people,
        F.col("labour_hours"),
        labour_cost.alias("labour_cost_total"),
        supplier.alias("supplier_costs_total"),
        total_costs.alias("total_costs"),
        value.alias("total_quote_value"),
        gp.alias("gross_profit"),
        F.when(value != 0, F.round(gp / value, 2)).otherwise(F.lit(0.0)).alias("gp_margin_pct"),
        F.round(value * F.lit(OVERHEAD_PCT), 2).alias("est_proj_overhead"),
        F.coalesce(F.col("n_cost_rows"), F.lit(0)).alias("n_cost_rows"),
        (F.coalesce(F.col("n_cost_rows"), F.lit(0)) > 0).alias("xero_costs_linked"),
        F.coalesce(F.col("n_quote_links"), F.lit(0)).alias("n_quote_links"),
        "work_start", "work_end", "longitude", "latitude", "sum_concrete_qty", "sum_asphalt_qty",
    )


def item_budget(sales_items: DataFrame, cost_calcs: DataFrame, *, code: str = "code",
                calc_code: str = "xero_code", rate: float = LABOUR_RATE) -> DataFrame:
    """M10 (+A7, J7): per sales item hours, labour cost, supplier cost, cost,
    margin, cost % and margin %; items without build-up keep nulls; a zero
    sale price gives null percentages (``try_divide``)."""
    c = cost_calcs.groupBy(F.col(calc_code).alias("_code")).agg(
        F.sum(F.when(F.col("cost_type") == "Labour", F.col("amount")).otherwise(F.lit(0))).alias("total_labour_hours"),
        F.sum(F.when(F.col("cost_type") == "Supplier", F.col("total")).otherwise(F.lit(0))).alias("total_supplier_costs"))
    j = sales_items.join(c, sales_items[code] == c["_code"], "left").drop("_code")
    passed = [x for x in sales_items.columns if x not in (code, "name", "sale_price")]  # Unit, flags, notes, ...
    lab_cost = F.col("total_labour_hours") * F.lit(rate)
    cost = lab_cost + F.col("total_supplier_costs")
    margin = F.col("sale_price") - cost
    return j.select(
        code, "name", "sale_price",
        F.col("total_labour_hours").alias("labour_hours_per_unit"),
        lab_cost.alias("labour_cost_per_unit"),
        F.col("total_supplier_costs").alias("supplier_costs_per_unit"),
        cost.alias("cost_per_unit"),
        margin.alias("margin"),
        F.try_divide(cost, F.col("sale_price")).alias("cost_pct"),
        F.try_divide(margin, F.col("sale_price")).alias("margin_pct"), *passed,
    )


def price_book_cost(hours: str = "hours", material: str = "material", rate: float = LABOUR_RATE):
    """``coalesce(hours, 0) * rate + coalesce(material, 0)`` (null as zero)."""
    return F.coalesce(F.col(hours), F.lit(0.0)) * F.lit(rate) + F.coalesce(F.col(material), F.lit(0.0))


def replace_rows_for_key(table: DataFrame, new_rows: DataFrame, key: str) -> DataFrame:
    """Overwrite-by-key — drop the old rows of every key present in
    ``new_rows`` and append the new ones."""
    return table.join(new_rows.select(key).distinct(), key, "left_anti").unionByName(new_rows)


def margin_summary(code: str = "code", margin: str = "margin", margin_pct: str = "margin_pct"):
    """One summary line per item, money with two decimals and whole percents
    (half to even); a null margin prints as 0."""
    money = F.coalesce(F.col(margin), F.lit(0.0)).cast("decimal(18,2)").cast("string")
    pct = F.bround(F.coalesce(F.col(margin_pct), F.lit(0.0)) * 100, 0).cast("long").cast("string")
    return F.concat(F.col(code), F.lit(": margin $"), money, F.lit(" ("), pct, F.lit("%)"))

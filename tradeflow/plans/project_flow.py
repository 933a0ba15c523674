"""Composition of the operators into the reference's table graph.

cards -> jobs -> job/quote mapping (J2) -> jobs with hours (J6)
tasks -> labour (S5/J1/F8/F9) -> cleaned labour (P3)
jobs -> links (J10) -> groups (X2) -> projects (X5) -> cost/labour links (J4)
     -> project roll-up (M1-M9)

Plain function composition over lazy DataFrames; Spark plans each result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.functions.text import inclusive_days, total_hours
from tradeflow.operators import finance, graph, jobs as J, quotes as Q
from tradeflow.operators.aggregate import labour_per_key
from tradeflow.operators.joins import explode_ids_lookup, left_join_with_gap, resolve_link_urls
from tradeflow.plans.fixtures import fixture, table_rows
from tradeflow.session import counted, dealt, lookup, tasks_for, tasks_in_need, written


def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Q.normalise_source_a(fixture(spark, sf_dir, "quote_src_a"))
    b = Q.normalise_source_b(fixture(spark, sf_dir, "quote_src_b"))
    return Q.union_quotes(b, a)


def labour_hours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scheduler tasks -> labour rows (name, start, end, employee, daily
    hours, inclusive day count, total hours); unknown people -> rejects."""
    tasks = dealt(fixture(spark, sf_dir, "tasks"), table_rows(spark, sf_dir, "lineitem"), "project_id")
    rows, rejected = explode_ids_lookup(
        tasks, lookup(fixture(spark, sf_dir, "people"), table_rows(spark, sf_dir, "supplier")),
        lookup(fixture(spark, sf_dir, "sched_projects"), table_rows(spark, sf_dir, "customer")))
    out = rows.select(
        F.concat_ws(":", "task_id", "employee").alias("labour_id"),
        "name", "start_date", "end_date", "employee",
        F.col("hours").alias("daily_hours"),
        inclusive_days("start_date", "end_date").alias("num_days"),
    ).withColumn("total_hours", total_hours("num_days", "daily_hours"))
    return out, rejected


def jobs_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cards = fixture(spark, sf_dir, "job_cards")
    cleaned, removed = J.split_cards(cards)
    return J.jobs_from_cards(cleaned), removed


def jobs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs, written: for queries that read them more than once."""
    return written(jobs_table(spark, sf_dir)[0], "jobs")


def quote_headers(spark: SparkSession, sf_dir: str, raw_value: str | None = None) -> DataFrame:
    """A1 over the quote lines, dealt by quote over as many tasks as the lines need: a task sorts the quotes it
    groups, of which an aggregate's own exchange would give it more with larger tables."""
    return Q.quote_headers(dealt(quote_lines(spark, sf_dir), table_rows(spark, sf_dir, "lineitem"), "quote_no"), raw_value=raw_value)


def ref_quotes(spark: SparkSession, sf_dir: str, headers: DataFrame | None = None) -> DataFrame:
    """A2, written: a task sorts the quotes of the references it has, so there are as many tasks as the lines need."""
    headers = headers if headers is not None else quote_headers(spark, sf_dir)
    with tasks_in_need(spark, table_rows(spark, sf_dir, "lineitem")):
        return written(Q.latest_quote_per_ref(headers), "ref-quotes")


def mapping_table(spark: SparkSession, sf_dir: str, jobs: DataFrame | None = None,
                  headers: DataFrame | None = None) -> DataFrame:
    jobs = jobs if jobs is not None else jobs_once(spark, sf_dir)
    refs = ref_quotes(spark, sf_dir, headers)
    with tasks_in_need(spark, table_rows(spark, sf_dir, "lineitem")):
        return counted(written(J.job_quote_mapping(jobs, refs), "mapping"))


def jobs_with_hours(spark: SparkSession, sf_dir: str, jobs: DataFrame | None = None,
                    labour: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """J6 + A3: jobs left-joined with per-job labour; second frame = jobs without hours."""
    jobs = jobs if jobs is not None else jobs_table(spark, sf_dir)[0]
    labour = labour if labour is not None else dealt(
        J.filter_labour(labour_hours(spark, sf_dir)[0])[0], table_rows(spark, sf_dir, "lineitem"), "name", "employee")
    return left_join_with_gap(jobs, labour_per_key(labour), ["name"])


def link_edges(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J10 over the attachments classified as linked cards."""
    att = J.attachment_links(jobs).filter(F.col("kind") == "linked_cards").select("name", "url")
    return resolve_link_urls(att, jobs.select("name", "short_url"), name_col="name", url_col="url", id_col="short_url")


def members_table(jobs: DataFrame) -> DataFrame:
    """X1 + X2 + X4 + X5: (project, name, shared_drains)."""
    shared, standalone = graph.split_shared(jobs)
    edges, _ = link_edges(jobs)
    groups = graph.greedy_groups(shared.select("name", F.col("card_id").alias("ord")), jobs, edges)
    return graph.project_members(groups, standalone)


class Parts(NamedTuple):
    """The projects, and the written tables that they and the queries beside them read."""
    projects: DataFrame
    jobs: DataFrame
    members: DataFrame
    mapping: DataFrame


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one row per project with its financials."""
    return project_parts(spark, sf_dir).projects


def project_parts(spark: SparkSession, sf_dir: str) -> Parts:
    """The projects with what they are made of, for queries that read both."""
    # What several branches read is written once: jobs, one row per quote, cleaned
    # labour, and the bridge tables. That keeps each plan small and each rerun short.
    jobs = jobs_once(spark, sf_dir)
    # Bookings are only summed per job name, their spans too: one row per name is written, not every booking.
    labour = written(labour_per_key(J.filter_labour(labour_hours(spark, sf_dir)[0])[0], start_date=F.min("start_date"),
                                    end_date=F.max("end_date")).select("name", "labour_hours", "start_date", "end_date"), "labour")
    headers = written(quote_headers(spark, sf_dir, "value_raw"), "quote-headers")
    values = headers.select("quote_no", "value_raw")
    mapping = mapping_table(spark, sf_dir, jobs, headers.drop("value_raw"))
    members = written(members_table(jobs), "members")
    costs = written(fixture(spark, sf_dir, "costs").select("row_id", "Project", "Description", "Gross"), "costs")
    cost_links = finance.link_rows_to_projects(finance.project_needles(members), costs, row_id="row_id",
                                               text_cols=["Project", "Description"], stored=True,
                                               tasks=tasks_for(spark, table_rows(spark, sf_dir, "lineitem")))
    # Work start/end only need min(start)/max(end) of the linked rows, so the
    # contains join runs on names, not on every booking.
    labour_spans = labour.select("name", "start_date", "end_date", F.col("name").alias("labour_id"))
    labour_links = written(finance.link_rows_to_projects(
        finance.project_needles(members, with_raw_name=False), labour_spans, row_id="labour_id",
        text_cols=["name"]), "labour-links")
    rolled = finance.project_rollup(members, jobs, mapping, values, cost_links, costs, labour_links, labour_spans, labour)
    return Parts(rolled, jobs, members, mapping)

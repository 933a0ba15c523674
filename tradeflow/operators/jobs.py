"""Job-card operators.

Cards -> (kept, removed) -> jobs (one row per job name) -> job/quote mapping.
Every function is generic over the column names it is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeflow.functions.text import (DUPLICATE_MARKERS, attachment_class, clean_address_suffix,
                                      has_label, suburb)
from tradeflow.operators.joins import anti_join, match_type
from tradeflow.operators.link import phrase_join
from tradeflow.session import counted, cut_lineage


def _any_contains(c: Column, markers: Sequence[str]) -> Column:
    cond = F.lit(False)
    for m in markers:
        cond = cond | c.contains(m)
    return cond


def split_cards(cards: DataFrame, *, title: str = "card_title", keys: Sequence[str] = ("short_url", "card_title"),
                markers: Sequence[str] = DUPLICATE_MARKERS) -> tuple[DataFrame, DataFrame]:
    """P1 + J5: removed = title has a duplicate marker or does not start with a
    digit; cleaned = cards anti-joined with removed on ``keys`` (so a key
    shared with a removed card drops every copy, as in the reference)."""
    t = F.col(title)
    dup = F.coalesce(_any_contains(t, markers), F.lit(False))
    not_job = ~F.coalesce(t.rlike(r"(?U)^\d"), F.lit(False))
    reason = F.when(dup, F.lit("duplicate_marker")).when(not_job, F.lit("not_a_job_title"))
    flagged = cards.withColumn("reason", reason)
    removed = flagged.filter(F.col("reason").isNotNull())
    cleaned = anti_join(cards, removed, keys)
    return cleaned, removed


def split_malformed_addresses(jobs: DataFrame, address: str = "address",
                              markers: Sequence[str] = DUPLICATE_MARKERS) -> DataFrame:
    """Reason per row — duplicate marker, more than one comma, job part not
    ``^\\d{1,5}\\D{1,2}`` — else kept with job / suburb split (reason null)."""
    a = F.col(address)
    n_commas = F.size(F.split(a, ",")) - 1
    job_part = clean_address_suffix(F.split(a, ",").getItem(0))
    reason = (F.when(_any_contains(a, markers), "duplicate")
              .when(n_commas > 1, "more_than_one_comma")
              .when(~job_part.rlike(r"^\d{1,5}\D{1,2}"), "malformed_job_name"))
    return jobs.withColumn("reason", reason) \
        .withColumn("job", F.when(F.col("reason").isNull(), job_part)) \
        .withColumn("suburb", F.when(F.col("reason").isNull(), F.trim(F.split(a, ",").getItem(1))))


def filter_labour(labour: DataFrame, *, name: str = "name", employee: str = "employee",
                  excluded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """kept = employee not excluded and name starts with a digit (name then
    cleaned with F1); rejected = the true complement with a reason (Q3, Q4)."""
    e, n = F.col(employee), F.col(name)
    ex = e.isin(list(excluded)) if excluded else F.lit(False)
    reason = (F.when(e.isNull() | n.isNull(), "null_key")
              .when(ex, "excluded_employee")
              .when(~n.rlike(r"(?U)^\d"), "name_not_a_job"))
    flagged = labour.withColumn("reason", reason)
    # known not to be null, the cleaned name is made once a row: a join on it does not make it again to look for nulls
    cleaned = F.coalesce(clean_address_suffix(name), F.lit(""))
    kept = flagged.filter(F.col("reason").isNull()).drop("reason").withColumn(name, cleaned)
    return kept, flagged.filter(F.col("reason").isNotNull())


def jobs_from_cards(cards: DataFrame, *, title: str = "card_title", order: str = "card_id",
                    labels: str = "labels", attachments: str = "attachments",
                    shared_label: str = "Shared Drain") -> DataFrame:
    """T10 + F1 + F10 + F13 + X6: one row per job name.

    name = F1(title); ``shared_drains`` from the label array; ``suburb`` from
    the address; the same name twice -> the later card (by ``order``) wins.
    """
    jobs = cards.withColumn("name", clean_address_suffix(title)) \
        .withColumn("shared_drains", has_label(labels, shared_label))
    if "address" in cards.columns:
        jobs = jobs.withColumn("suburb", suburb("address"))
    cols = jobs.columns
    latest = jobs.groupBy("name").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("r"))
    return latest.select("r.*")


def attachment_links(jobs: DataFrame, *, name: str = "name", attachments: str = "attachments") -> DataFrame:
    """one row per (job, attachment url, class); skipped urls dropped."""
    ex = jobs.select(name, F.explode_outer(attachments).alias("url")).filter(F.col("url").isNotNull())
    return ex.withColumn("kind", attachment_class("url")).filter(F.col("kind").isNotNull())


def job_quote_mapping(jobs: DataFrame, ref_quotes: DataFrame, *, job_name: str = "name",
                      job_no: str = "short_url", ref_key: str = "ref_key",
                      status: str = "status", board: str = "board_name",
                      no_quote_status: str = "NFA, No Damage, PVC",
                      no_quote_board: str = "Survey Workflow") -> DataFrame:
    """J2 + J3 + P9: the job_quote_mapping table.

    ``ref_quotes`` has one quote per reference key (A2); it and ``jobs`` are written tables, which are counted. Rows: every
    (job, quote) phrase match tagged 'primary' / 'variation'; plus one
    'no_match' row (null quote columns) for each job with no primary quote
    whose status and board are not the exempt ones.
    """
    pairs, _ = phrase_join(jobs.select(job_name), ref_quotes.select(ref_key),
                           name_id=job_name, name_col=job_name, text_id=ref_key, text_col=ref_key)
    q = ref_quotes.select(ref_key, "quote_no", "quote_ref", "quote_value")
    matched = (pairs.join(counted(q), ref_key)
               .join(counted(jobs.select(job_name, job_no)), job_name)
               .select(F.col(job_name).alias("job_name"), F.col(job_no).alias("job_no"), "quote_no", "quote_ref",
                       match_type(F.col(ref_key)).alias("match_type"), "quote_value"))
    matched = cut_lineage(matched)  # two branches read it
    has_primary = matched.filter(F.col("match_type") == "primary").select(F.col("job_name").alias(job_name)).distinct()
    no_match = (jobs.join(has_primary, job_name, "left_anti")
                .filter((F.coalesce(F.col(status), F.lit("")) != no_quote_status)
                        & (F.coalesce(F.col(board), F.lit("")) != no_quote_board))
                .select(F.col(job_name).alias("job_name"), F.col(job_no).alias("job_no"),
                        F.lit(None).cast("string").alias("quote_no"), F.lit(None).cast("string").alias("quote_ref"),
                        F.lit("no_match").alias("match_type"), F.lit(None).cast("double").alias("quote_value")))
    return matched.unionByName(no_match)


def customers(cards: DataFrame, *, name: str = "customer_name", order: str = "card_id",
              email: str = "customer_email", phone: str | None = None, job: str = "card_title") -> DataFrame:
    """A5: per customer name (null is one group) the first-seen email/phone and
    the number of jobs; the ordered job list is :func:`customer_jobs`."""
    first = [F.min_by(email, order).alias("email")]
    if phone:
        first.append(F.min_by(phone, order).alias("phone"))
    return cards.groupBy(F.col(name).alias("name")).agg(*first, F.count(F.lit(1)).alias("n_jobs"),
                                                        F.min_by(job, order).alias("first_job"))


def customer_jobs(cards: DataFrame, *, name: str = "customer_name", order: str = "card_id",
                  job: str = "card_title") -> DataFrame:
    """A5 job list as bridge rows (customer, position, job) in card order."""
    from tradeflow.operators.aggregate import ordered_members
    return ordered_members(cards.select(F.col(name).alias("name"), F.col(job).alias("job_name"), order),
                           "name", order, "job_name")


def flatten_structs(df: DataFrame, *structs: str) -> DataFrame:
    """Spread struct fields to top-level columns, keeping the structs."""
    return df.select("*", *[F.col(f"{s}.*") for s in structs])


def build_job_structs(df: DataFrame, groups: dict[str, dict[str, str]]) -> DataFrame:
    """``{struct_name: {field: source_column}}`` -> struct columns (missing sources -> null)."""
    out = df
    for sname, fields in groups.items():
        out = out.withColumn(sname, F.struct(*[
            (F.col(src) if src in df.columns else F.lit(None)).alias(f) for f, src in fields.items()]))
    return out

"""What a task holds, moves or computes once grew faster than the tables."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tradeflow import session
from tradeflow.functions.text import STREET_SUFFIXES, remove_suffixes_in_order
from tradeflow.llm.repeats import _slices
from tradeflow.operators import finance, jobs as J, joins, link, quotes as Q
from tradeflow.plans import project_flow as PF, q_misc
from tradeflow.plans.fixtures import BASE_TABLES, FIXTURES, SPARK, fixture, tables
from tradeflow.streaming import labour_feed as feed

SMALL = "/root/testdata/sf0.001"


def test_categories_of_long_lines(spark):
    """The patterns with repeated look-aheads overflow the stack on lines of this length."""
    long = "Remove and replace pipe and fence, " * 1500
    texts = [long, long + "gully", None, "", "a deck", "relay Pavers", "old pavers set", "Pipelining, pavers set", "bubble",
             "Remove and replace sewer", "Remove and replace x sewer", "remove and replace x stormwater and sewer", ",hared ,rench",
             "connect to deck", "Deck", " ,eck", "remove and replace aspha", "remove and replace asphal", "manhole trench", "AP20/40"]
    lines = spark.createDataFrame([(str(i), t, 1.0, 2.0) for i, t in enumerate(texts)],
                                  "quote_no string, item_desc string, line_pct double, quantity double")
    got = {(r.quote_no, r.category) for r in Q.line_category_matrix(lines).collect()}
    held = {(str(i), k) for i, t in enumerate(texts) if t is not None for k, _, r, _ in Q.QUOTE_CATEGORIES
            if (t[:4] != long[:4] or len(t) < 100) and re.search(r, t)}
    simple = {k for k, _, r, _ in Q.QUOTE_CATEGORIES if "(?!" not in r}
    held |= {(str(i), k) for i in (0, 1) for k, _, r, _ in Q.QUOTE_CATEGORIES if k in simple and re.search(r, texts[i])}
    assert got == held and ("1", "gully") in got and ("4", "deck") in got


def test_every_match_holds_the_text_looked_for():
    for k, _, r, _ in Q.QUOTE_CATEGORIES:
        plain = re.sub(r"\\[(.),.\\]", r"\\1", r)
        for x in Q._HELD[k]:
            assert x in re.sub(r"\[(.),(.)\]", r"\2", plain) or x in plain, (k, x)


@pytest.mark.parametrize("name", ["quote_src_a", "quote_src_b", "tasks", "costs"])
def test_line_fixtures_are_their_plain_text(spark, monkeypatch, name):
    """Also where the lookups are hashed and the lines dealt over many tasks."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    text, base = FIXTURES[name](SPARK), tables(spark, SMALL)
    plain = spark.sql(text, **{t: base[t] for t in BASE_TABLES if "{" + t + "}" in text})
    got = fixture(spark, SMALL, name)
    assert got.schema == plain.schema and got.rdd.getNumPartitions() >= 12
    assert not got.exceptAll(plain).head(1) and not plain.exceptAll(got).head(1)


def test_labour_meets_its_lookups_unsorted(spark, monkeypatch):
    plain = PF.labour_hours(spark, SMALL)[0].collect()
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    rows = PF.labour_hours(spark, SMALL)[0]
    lookups = rows._jdf.queryExecution().sparkPlan().toString()
    assert lookups.count("ShuffledHashJoin") == 3
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain))


def test_filtered_keys_lose_no_match(spark, monkeypatch):
    """The way of many needles: the filter, with bits so few that it lets much pass, and texts that repeat."""
    monkeypatch.setattr(link, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(link, "FILTER_BITS", 1 << 16)
    names = [(i, f"{i} Main Road"[: 5 + i % 20]) for i in range(1, 400)]
    texts = [(j, f"pipe for {j % 700} Main Road, Unit {j % 7}") for j in range(1200)] + [(5, "5 Main Road"), (9, None), (10, "")]
    n, t = spark.createDataFrame(names, "id long, n string"), spark.createDataFrame(texts, "tid long, t string")
    got = [tuple(r) for r in link.contains_join(n, t, needle_id="id", needle_col="n", text_id="tid", text_col="t").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in names for j, y in texts if y and x in y}
    keys = spark.range(1000).select(F.lit(8).alias("_class"), F.col("id").alias("_key"))
    passed = link.key_filter(keys, 1000)(spark.range(100000).select(F.lit(8).alias("_class"), F.col("id").alias("_key")))
    left = {r._key for r in passed.collect()}
    assert left >= set(range(1000)) and len(left) < 5000


def test_exact_links_of_a_group_are_preferred(spark):
    links = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, None), ("b", 4, False), (None, 5, True), ("a", 6, None)],
                                  "project string, row_id int, e boolean")
    assert sorted(r.row_id for r in link.prefer_exact(links, group="project", exact="e").collect()) == [1, 3, 4]


def test_places_of_hot_keys_are_those_of_a_window(spark, monkeypatch):
    rows = [(k, (i * 7919) % 1000) for k, n in (("hot", 400), ("a", 5), (None, 30), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o int")
    want = sorted((k or "", o, p) for k in {k for k, _ in rows} for p, o in enumerate(sorted(o for x, o in rows if x == k)))
    for hot in (10, 1 << 18):
        monkeypatch.setattr(joins, "HOT_ROWS", hot)
        got = joins.occurrences(df, ["k"], ["o"])
        assert sorted((r.k or "", r.o, r.occurrence) for r in got.collect()) == want and got.columns == ["k", "o", "occurrence"]


def test_exports_get_more_files_with_more_rows(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("key"), F.concat(F.lit("x"), "id").alias("line"))
    for n, files in ((500, 8), (20 * session.TASK_ROWS, 20)):
        path = f"{tmp_path}/{n}"
        q_misc._exported(rows, ["title", "head"], path, n)
        read = spark.read.text(path)
        assert read.filter("value = 'title'").count() == files and read.count() == 500 + 2 * files


def test_quote_headers_get_more_tasks_with_more_lines(spark, monkeypatch):
    """Their task's sort grew with the tables."""
    plain = sorted(map(tuple, Q.quote_headers(PF.quote_lines(spark, SMALL)).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    got = PF.quote_headers(spark, SMALL)
    assert got.rdd.getNumPartitions() >= 12 and sorted(map(tuple, got.collect())) == plain


def test_mapping_gets_more_tasks_and_sends_no_large_table_to_all(spark, monkeypatch):
    """Sorts of references grew with the tables, and tables that are small only on disk went to each task."""
    jobs = PF.jobs_once(spark, SMALL)
    plain = sorted(map(str, PF.mapping_table(spark, SMALL, jobs).collect()))
    own, seen, plans = spark.conf.get("spark.sql.shuffle.partitions"), {}, []
    real, cut = PF.written, J.cut_lineage

    def noted(df, name):
        seen[name] = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return real(df, name)

    monkeypatch.setattr(PF, "written", noted)
    monkeypatch.setattr(J, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    got = PF.mapping_table(spark, SMALL, jobs)
    assert seen == {"ref-quotes": 12, "mapping": 12} and spark.conf.get("spark.sql.shuffle.partitions") == own
    joins_of = plans[0].split("== Physical Plan ==")[1]
    assert joins_of.count("SortMergeJoin") >= 3
    assert sorted(map(str, got.collect())) == plain


def test_quotes_of_projects_are_met_where_the_names_are(spark, monkeypatch):
    """The written mapping, small on disk, does not go to all tasks by its size there."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    mapping = PF.mapping_table(spark, SMALL)
    names = mapping.select(F.col("job_name").alias("name")).distinct()
    plan = names.join(mapping.filter("match_type = 'primary'"), F.col("name") == F.col("job_name"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan.split("== Physical Plan ==")[1] and "BroadcastHashJoin" not in plan.split("== Physical Plan ==")[1]


def test_roll_up_sums_links_before_the_preference(spark, monkeypatch):
    """Of a project's links two rows at most are written (F2 to F4); a row id that repeats counts each of its rows."""
    made = {}

    def spied(df, name):
        made[name] = (out := session.written(df, name)).count()
        return out

    monkeypatch.setattr(link, "written", spied)
    costs = [(f"r{i}", float(i), "1 Main" if i % 3 == 0 else "x") for i in range(60)] + [("r3", 0.5, "y"), ("n", None, None)]
    frame = spark.createDataFrame
    out = finance.project_rollup(
        frame([("1 Main", "1 Main", False), ("2 Low", "2 Low", False), ("3 No", "3 No", False)], "project string, name string, shared_drains boolean"),
        frame([(n, None, None, None, 1.0, 2.0, 1.0, 1.0, False) for n in ("1 Main", "2 Low", "3 No")],
              "name string, project_manager string, surveyed_by string, status string, longitude double, latitude double, "
              "concrete_qty double, asphalt_qty double, shared_drains boolean"),
        frame([], "job_name string, quote_no string, match_type string"), frame([], "quote_no string, value_raw double"),
        frame([(p, f"r{i}") for p in ("1 Main", "2 Low") for i in range(60)] + [("2 Low", "n")], "project string, row_id string"),
        frame(costs, "row_id string, Gross double, Project string"),
        frame([], "project string, labour_id string"), frame([], "labour_id string, start_date date, end_date date"),
        frame([], "name string, labour_hours double"))
    got = {r.project: (r.supplier_costs_total, r.n_cost_rows) for r in out.collect()}
    assert got == {"1 Main": (float(sum(range(0, 60, 3))), 20), "2 Low": (sum(range(60)) + 0.5, 62), "3 No": (0.0, 0)}
    assert 0 < made["flagged-links"] <= 4


def test_pairs_dealt_by_text_are_the_same(spark):
    n = spark.createDataFrame([(i, f"{i} Main") for i in range(50)], "id long, n string")
    t = spark.createDataFrame([(j, f"for {j % 70} Main, Unit") for j in range(300)] + [(5, "7 Main")], "tid long, t string")
    own = dict(needle_id="id", needle_col="n", text_id="tid", text_col="t")
    got = link.contains_join(n, t, **own, tasks=13)
    assert got.rdd.getNumPartitions() == 13
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, link.contains_join(n, t, **own).collect()))


def test_suffixes_go_in_order_each_once(spark):
    parts = ["", "1 Main", " St", " St.", " Street", " Ave", " Avenue", " street", " Rd", " rd", " Pl", "é😀", ".", " Stx", " STREET"]
    texts = [a + b + c + d for a in parts[:2] for b in parts for c in parts for d in parts] + [None]

    def walked(x, suffixes):
        for s in suffixes:
            x = x[:-len(s)] if s and x.endswith(s) else x
        return x

    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for suffixes in (STREET_SUFFIXES, ("", "a+", "(b", "\\E", " St", "é😀", ".")):
        got = {r.t: r.o for r in df.select("t", remove_suffixes_in_order("t", suffixes).alias("o")).collect()}
        assert got == {x: x and walked(x, suffixes) for x in texts}


def test_names_are_cleaned_once_a_row(spark):
    """A join on the cleaned name made it again, to look for nulls."""
    labour = spark.createDataFrame([("1 Main St", "a"), (None, "b"), ("x", "c"), ("2 Low", None)], "name string, employee string")
    kept = J.filter_labour(labour)[0]
    members = spark.createDataFrame([("p", "1 Main")], "project string, name string")
    joined = kept.join(members.hint("shuffle_hash"), "name")
    assert [tuple(r) for r in joined.collect()] == [("1 Main", "a", "p")]
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("reverse(") <= 2


def test_feed_keeps_its_state_on_disk(spark, tmp_path):
    """The default store holds every key in memory."""
    before = {k: spark.conf.get(k, None) for k in feed.STATE_STORE}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"task_id":"1","name":"n","employee":"e","start_date":"2024-01-01","end_date":"2024-01-02",'
                                            '"daily_hours":1.5,"exported_at":"2024-01-01T00:00:00"}\n' * 2)
    feed.start_feed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    state = tmp_path / "state" / "state" / "0"
    assert list(state.rglob("*.zip")) or list(state.rglob("*.changelog"))
    assert {k: spark.conf.get(k, None) for k in feed.STATE_STORE} == before


def test_documents_are_held_in_slices():
    """A task held the runs of a whole batch of documents at once."""
    import pyarrow as pa
    got = list(_slices([{"a": pa.array(range(600)), "b": pa.array(range(600))}, {"a": pa.array([]), "b": pa.array([])}]))
    assert [len(b["a"]) for b in got] == [256, 256, 88] and sum((b["b"].to_pylist() for b in got), []) == list(range(600))


def test_writes_leave_no_shuffle_files(spark):
    """They stayed beside the table that was written of them."""
    def shuffles():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return set(re.findall(r"shuffle_(\d+)_", disk.getAllFiles().mkString(" ")))

    df, (key,), before = spark.range(5000).groupBy((F.col("id") % 100).alias("g")).count(), session.CLEAN_UP, shuffles()
    own = spark.conf.get(key, None)
    assert session.written(df, "t").count() == 100 and spark.conf.get(key, None) == own
    for _ in range(50):
        if len(left := shuffles() - before) <= 1:
            break
        time.sleep(0.1)
    assert len(left) <= 1  # that of the count

"""Findings of round 4: needles that share their parts, stretches of texts, what queries make once."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from bruteforce import contains_pairs
from tradeflow import session
from tradeflow.llm import negatives
from tradeflow.operators import finance, link, windows
from tradeflow.plans import project_flow as PF, q_misc, q_projects, q_quality
from tradeflow.streaming import labour_feed as feed


# -- J4 ---------------------------------------------------------------------

@pytest.mark.parametrize("broadcast_keys", [200_000, 0])
def test_needles_that_share_their_parts_meet_only_their_texts(spark, monkeypatch, broadcast_keys):
    """F2: a needle was blocked on one of its parts, which many needles and texts have (here 1.4 million pairs of 2,048 matches)."""
    monkeypatch.setattr(link, "BROADCAST_KEYS", broadcast_keys)
    names = spark.range(2048).select(F.col("id").alias("_nid"), F.lpad(F.bin("id"), 11, "0").alias("_nv"))
    texts = names.select(F.col("_nid").alias("_tid"), F.concat(F.lit("for "), "_nv").alias("_tv"))
    assert 2048 <= link.contains_candidates(names, texts).count() <= 2100


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 17])
def test_windows_over_the_ends_of_stretches_are_found(spark, size):
    r = random.Random(size)
    words = ["12", "main", "Häuser", "😀x", "aaaa", "aaaaaaaa", ", ", "#"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    names = sorted({text(r.randrange(1, 9))[: r.randrange(1, 45)] for _ in range(80)})
    texts = ["", *(text(r.randrange(0, 14)) for _ in range(60)), *(text(2) + n + text(1) for n in names), ""]
    n = spark.createDataFrame(list(enumerate(names)), "_nid long, _nv string")
    t = spark.createDataFrame(list(enumerate(texts)), "_tid long, _tv string").repartition(3)
    own = windows.needle_keys(n, "_nv").cache()
    lengths = {}
    for k, length in own.select("_class", "_length").distinct().collect():
        lengths.setdefault(k, []).append(length)
    assert {1, 7, 8, 16, 32} <= set(lengths)
    keys = windows.text_keys(t, "_tv", windows.sieve(own, len(names)), lengths, size)
    got = keys.join(own, ["_class", "_key"]).select("_nid", "_tid").collect()
    assert set(map(tuple, got)) == contains_pairs(list(enumerate(names)), list(enumerate(texts)))
    by_chance = keys.join(own, ["_class", "_key"], "left_anti").count()
    assert by_chance <= 0.05 * len(got)


# -- projects and what reads them -------------------------------------------

@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few rows of each driver table that the projects are made of."""
    path = str(tmp_path_factory.mktemp("small"))
    day = "timestamp'1996-01-01 00:00:00'"
    for name, sql in {
            "nation": "SELECT CAST(id AS INT) AS n_nationkey, 'N' || id AS n_name, CAST(id % 5 AS INT) AS n_regionkey FROM range(3)",
            "customer": "SELECT id AS c_custkey, 'Customer#' || id AS c_name, CAST(id % 3 AS INT) AS c_nationkey, id * 700.0D AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(1, 9)",
            "supplier": "SELECT id AS s_suppkey, 'Supplier#' || id AS s_name, CAST(0 AS INT) AS s_nationkey, 1.0D AS s_acctbal FROM range(4)",
            "part": "SELECT id AS p_partkey, 'hot bolt' AS p_name, 'Brand#1' AS p_brand, 'PROMO' AS p_type, 3 AS p_size, 9.5D AS p_retailprice FROM range(3)",
            "orders": f"SELECT id AS o_orderkey, 1 + id % 8 AS o_custkey, 'O' AS o_orderstatus, 10.0D AS o_totalprice, {day} AS o_orderdate, "
                      "IF(id % 4 = 0, '1-URGENT', '2-HIGH') AS o_orderpriority FROM range(16)",
            "lineitem": "SELECT id % 16 AS l_orderkey, id % 3 AS l_partkey, id % 4 AS l_suppkey, CAST(1 + id DIV 16 AS INT) AS l_linenumber, 2.0D AS l_quantity, "
                        f"10.0D + id AS l_extendedprice, 0.1D AS l_discount, 0.1D AS l_tax, IF(id % 3 = 0, 'R', 'N') AS l_returnflag, "
                        f"IF(id % 2 = 0, 'O', 'F') AS l_linestatus, {day} AS l_shipdate FROM range(48)"}.items():
        spark.sql(sql).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("query", ["dq_suite", "dq_summary", "dq_consistency", "projects_formatted"])
def test_queries_make_the_parts_of_projects_once(spark, monkeypatch, small, query):
    """Jobs, the mapping or the members were made twice, and the projects for each check that reads them."""
    made = []

    def spied(df, name):
        made.append(name)
        return session.written(df, name)

    for module in (PF, q_quality, q_projects):
        monkeypatch.setattr(module, "written", spied)
    rolled = finance.project_rollup
    monkeypatch.setattr(finance, "project_rollup", lambda *a, **k: made.append("rolled") or rolled(*a, **k))
    rows = (q_projects if query.startswith("projects") else q_quality).__dict__[query](spark, small).collect()
    assert len(rows) == {"dq_suite": 12, "dq_summary": 1, "dq_consistency": 5}.get(query, 8)
    assert [made.count(x) for x in ("jobs", "members", "mapping", "rolled")] == [1, 1, 1, 1]
    assert made.count("projects") == (query != "dq_consistency")  # read by more than one check, or by a sort


# -- W1 ---------------------------------------------------------------------

def test_feed_sends_small_files_and_leaves_no_batch(spark, monkeypatch, small, tmp_path):
    """exports lay in plain text, the state held whole bookings, a batch was kept in memory and on disk."""
    monkeypatch.setattr(q_misc, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(q_misc, "TASK_ROWS", 10)
    made = []
    monkeypatch.setattr(feed, "written", lambda df, name: made.append(session.written(df, name)) or made[-1])
    rows = q_misc.labour_feed(spark, small)
    want = PF.labour_hours(spark, small)[0].select(F.substring_index("labour_id", ":", 1).alias("task_id"), "name", "employee", "start_date", "end_date",
                                                   "daily_hours", "num_days", "total_hours").distinct()
    assert sorted(map(str, rows.select(want.columns).collect())) == sorted(map(str, want.collect()))
    files = list(tmp_path.glob("labour-feed/in/*/part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert max(len(gzip.open(f).readlines()) for f in files) <= 10
    assert len(made) >= 2
    for df in made:  # taken away when the batch was in the table
        with pytest.raises(Exception, match="(?i)not.*exist"):
            df.collect()


def test_feed_keeps_bookings_that_differ_in_the_place_of_a_null(spark, tmp_path):
    (tmp_path / "in").mkdir()
    one = {"task_id": None, "name": "a", "employee": None, "start_date": "2024-01-01", "end_date": "2024-01-02", "daily_hours": 1.5}
    sent = [one, one, one | {"name": None, "employee": "a"}, one | {"task_id": "a", "name": None}, one | {"daily_hours": None}, one | {"end_date": None}]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in sent))
    feed.start_feed(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


# -- op13 -------------------------------------------------------------------

@pytest.mark.parametrize("blocks", [3, 40])
def test_blocks_of_vectors_are_dealt_over_tasks(spark, blocks):
    """all blocks lay in one file, so that one task met all anchors."""
    frame = spark.createDataFrame
    data = session.written(frame([(2, i, 1, b"x") for i in range(blocks)] + [(3, 0, 1, b"y"), (5, 0, 1, b"z")], "len int, block int, n int, values binary").coalesce(1), "data")
    anchors = session.written(frame([(2, i, 1, b"a") for i in range(13)] + [(3, 0, 1, b"b"), (4, 0, 1, b"c")], "len int, block int, n int, values binary"), "anchors")
    cells = negatives.met(anchors, data)
    sizes = [len(p) for p in cells.rdd.glom().collect()]
    got = [(r.len, r.block, r.a_block, r.a_values) for r in cells.collect()]
    assert sorted(got) == sorted([(2, i, j, b"a") for i in range(blocks) for j in range(13)] + [(3, 0, 0, b"b")])
    assert max(sizes) <= 13 and sum(n > 0 for n in sizes) >= min(blocks, 13)

"""Winnowed substring keys, token pairs, prefix contraction, snapshots, the stateful feed, line merge, parsers, usage."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from bruteforce import contains_pairs, phrase_pairs
from tradeflow.operators import graph, joins, link, quality as DQ, reports as R
from tradeflow.operators.snapshots import Rule, Watched, compare, take
from tradeflow.sources import grid as G
from tradeflow.sources.parsers import default_parsers
from tradeflow.streaming import labour_feed as feed


# -- J4, J2 -----------------------------------------------------------------

@pytest.mark.parametrize("broadcast_keys", [200_000, 0])
def test_winnowed_join_equals_bruteforce_in_every_class(spark, monkeypatch, broadcast_keys):
    monkeypatch.setattr(link, "BROADCAST_KEYS", broadcast_keys)
    r = random.Random(21)
    words = ["12", "main", "Street", "Häuser", "😀x", "aaaa", "aaaaaaaa", "CANADA", ", ", "#", "drain"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    names = [(i, text(r.randrange(1, 9))[: r.randrange(1, 50)]) for i in range(120)] + [(500, ""), (501, None), (502, "a" * 40)]
    texts = [(i, text(r.randrange(0, 14))) for i in range(150)]
    texts += [(200 + i, text(3) + (names[i][1] or "") + text(2)) for i in range(120)] + [(900, None), (901, "a" * 39), (902, "b" + "a" * 41)]
    texts += [(i, t) for i, t in texts[:20]] + [(950, texts[0][1])]
    assert {min(len(n), 32) for _, n in names if n} >= {1, 3, 7, 8, 15, 16, 31, 32}
    n = spark.createDataFrame(names, "id long, n string")
    t = spark.createDataFrame(texts, "tid long, t string")
    got = [(x.id, x.tid) for x in link.contains_join(n, t, needle_id="id", needle_col="n", text_id="tid", text_col="t").collect()]
    assert len(got) == len(set(got)) and set(got) == contains_pairs(names, texts)
    none = link.contains_join(n.limit(0), t, needle_id="id", needle_col="n", text_id="tid", text_col="t")
    assert none.columns == ["id", "tid"] and none.count() == 0


def test_texts_emit_five_times_fewer_keys_than_substrings(spark):
    r = random.Random(2)
    names = spark.createDataFrame([(i, f"{i} Building Drive, CANADA"[:k]) for i in range(300) for k in (18, 40)], "_nid long, _nv string")
    lines = ["".join(r.choice("abcdefgh 123") for _ in range(120)) for _ in range(100)]
    texts = spark.createDataFrame(list(enumerate(lines)), "_tid long, _tv string")
    n_keys, keys_of = link.contains_keys(names)
    t_keys = keys_of(texts)
    assert n_keys.select("_class").distinct().count() == 1
    substrings = sum(len({t[i:i + 16] for i in range(len(t) - 15)}) for t in lines)  # what one key length emits
    assert t_keys.count() * 4 < substrings
    both = names.unionByName(spark.createDataFrame([(900, "x" * 33)], "_nid long, _nv string"))
    t_keys = link.contains_keys(both)[1](texts)
    substrings += sum(len({t[i:i + 32] for i in range(len(t) - 31)}) for t in lines)
    assert t_keys.count() * 5 < substrings


@pytest.mark.parametrize("broadcast_keys", [200_000, 0])
def test_phrase_join_of_token_pairs_equals_bruteforce(spark, monkeypatch, broadcast_keys):
    monkeypatch.setattr(link, "BROADCAST_KEYS", broadcast_keys)
    r = random.Random(8)
    words = ["12", "main", "st", "brand#2", "a.b", "x(y)", "élan", "foo_bar", "-", "main-st", "$", "12a"]
    names = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for i in range(80)] + [(100, "#"), (101, ""), (102, None), (103, "12  main")]
    texts = [(j, r.choice([" ", "  ", ", "]).join(r.choice(words) for _ in range(r.randint(0, 9))).upper()) for j in range(250)]
    texts += [(j, t) for j, t in texts[:10]] + [(900, None), (901, "#")]
    n, t = spark.createDataFrame(names, "id long, n string"), spark.createDataFrame(texts, "tid long, t string")
    pairs, chars = link.phrase_join(n, t, name_id="id", name_col="n", text_id="tid", text_col="t")
    got = [(x.id, x.tid) for x in pairs.collect()]
    want = {p for p in phrase_pairs(names, texts) if p[0] != 101}  # an empty name matches nothing here
    assert set(got) == want and any(a == 100 for a, _ in got)
    assert {x.id for x in chars.collect()} >= {100}
    # keys carry hashes, not texts
    assert dict(link.distinct_texts(t, "tid", F.col("t"))[1].dtypes)["_tid"] == "bigint"


# -- X2 ---------------------------------------------------------------------

def scan(order, links):
    lost = set()
    for s in sorted(order, key=order.get):
        if s not in lost:
            lost |= {d for d in links.get(s, ()) if d in order and order[s] < order[d]}
    return {n: n not in lost for n in order}


@pytest.mark.parametrize("first, most", [(4, 16), (64, 64), (1 << 14, 1 << 19)])
def test_greedy_seeds_equal_the_scan(spark, first, most):
    r = random.Random(first)
    for n, degree in ((40, 3), (120, 2)):
        order = {f"j{i:03d}": r.randrange(n // 2) if degree == 3 else i for i in range(n)}
        links = {s: r.sample(sorted(order), r.randint(0, degree)) for s in order}
        nodes = spark.createDataFrame(list(order.items()), "name string, ord long")
        edges = spark.createDataFrame([(s, d) for s, ds in links.items() for d in ds] + [("j000", "gone")], "src string, dst string")
        got = {x.name: x.is_seed for x in graph.greedy_seeds(nodes, edges, first_links=first, most_links=most).collect()}
        assert got == scan(order, links)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark):
    n = 10_000
    nodes = spark.range(n).select(F.col("id").alias("name"), F.col("id").alias("ord"))
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.greedy_seeds(nodes, edges, first_links=256)
    assert graph.greedy_seeds.rounds <= 20
    assert got.filter(F.col("is_seed") != (F.col("name") % 2 == 0)).count() == 0 and got.count() == n


# -- DQ2, DQ7 ---------------------------------------------------------------

def test_a_missing_required_column_is_a_failed_row(spark):
    cards = spark.createDataFrame([("a", "open"), ("b", "open")], "card_id string, status string")
    got = {x.check: x for x in DQ.job_card_checks(cards).collect()}
    assert not got["required_columns"].passed and got["required_columns"].observed == 1
    assert not got["job_title_share_pct"].passed and got["duplicate_ids"].passed


def taken(spark, path, quotes, jobs, hours, dates):
    q = spark.createDataFrame(quotes, "quote_no string, src string")
    j = spark.createDataFrame([(x,) for x in jobs], "name string")
    h = spark.createDataFrame([(x,) for x in hours], "name string")
    d = spark.createDataFrame([(x,) for x in dates], "at date")
    take(spark, path, {"quotes": Watched(q, source="src"), "jobs": Watched(j, "name"), "hours": Watched(h, "name"), "labour": Watched(d, dates=["at"])})


RULES = [Rule("grows", "quotes"), Rule("grows", "quotes", "Xero"), Rule("constant", "quotes", "Simpro"), Rule("unique", "jobs"),
         Rule("same_names", "jobs", "hours"), Rule("kept_names", "jobs"), Rule("not_more", "hours", "jobs"), Rule("not_before", "labour", "at"),
         Rule("schema", "jobs"), Rule("grows", "absent")]


def test_snapshots_pass_and_fail_each_rule(spark, tmp_path):
    day = dt.date(2020, 1, 1)
    first, later, worse = (f"{tmp_path}/{x}" for x in "abc")
    taken(spark, first, [("q1", "Xero"), ("q2", "Simpro")], ["1 a", "2 b", None], ["1 a", "2 b", None], [day, None])
    taken(spark, later, [("q1", "Xero"), ("q2", "Simpro"), ("q3", "Xero")], ["1 a", "2 b", None, "3 c"], ["1 a", "2 b", None, "3 c"], [day])
    good = {x.check if x.table != "absent" else "absent": x for x in compare(spark, first, later, RULES).collect()}
    assert len(good) == len(RULES) and all(x.passed for x in good.values())
    assert (good["grows"].observed, good["grows"].threshold, good["grows:Xero"].observed) == (3, 2, 2)
    taken(spark, worse, [("q2", "Simpro"), ("q4", "Simpro")], ["1 a", "1 a", "3 c"], ["1 a", "2 b", "2 b", "3 c"], [dt.date(2019, 2, 21), day])
    # the stored schema of jobs differs
    m = spark.read.parquet(f"{worse}/metrics").withColumn("text", F.regexp_replace("text", "^name string$", "name int"))
    m.write.parquet(f"{tmp_path}/m2")
    spark.read.parquet(f"{tmp_path}/m2").write.mode("overwrite").parquet(f"{worse}/metrics")
    bad = {(x.table, x.check): (x.passed, x.observed) for x in compare(spark, later, worse, RULES).collect()}
    assert bad == {("quotes", "grows"): (False, 2), ("quotes", "grows:Xero"): (False, 0), ("quotes", "constant:Simpro"): (False, 2),
                   ("jobs", "unique"): (False, 1), ("jobs", "same_names:hours"): (False, 3), ("jobs", "kept_names"): (False, 3),
                   ("hours", "not_more:jobs"): (False, 4), ("labour", "not_before:at"): (False, 1), ("jobs", "schema"): (False, None),
                   ("absent", "grows"): (True, 0)}


def test_digests_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 7 AS x")
    digest = lambda path: [x.number for x in spark.read.parquet(f"{path}/metrics").filter("metric = 'digest'").collect()]
    for k, d in enumerate((df, df.repartition(11).orderBy(F.desc("id")), df.withColumn("x", F.col("x") + (F.col("id") == 5).cast("int")))):
        take(spark, f"{tmp_path}/{k}", {"t": Watched(d)})
    assert digest(f"{tmp_path}/0") == digest(f"{tmp_path}/1") != digest(f"{tmp_path}/2")


# -- W1 ---------------------------------------------------------------------

def test_the_feed_reads_only_the_months_it_needs(spark, tmp_path):
    src, out, check = (tmp_path / x for x in ("in", "out", "check"))
    src.mkdir()
    row = lambda i, day, hours=8.0: {"task_id": f"t{i}", "name": "1 Foo", "employee": "E", "start_date": day, "end_date": day,
                                     "daily_hours": hours, "exported_at": "2024-01-10T00:00:00"}
    drops = [[row(1, "2024-01-01"), row(2, "2024-02-01"), row(3, None)], [row(1, "2024-01-01"), row(4, "2024-02-01"), row(2, "2024-02-01", 4.0)],
             [row(3, None), row(1, "2024-01-01")]]
    for k, rows in enumerate(drops):
        (src / f"{k}.json").write_text("".join(json.dumps(x) + "\n" for x in rows))
        feed.start_feed(spark, str(src), str(out), str(check)).awaitTermination(120)
    got = spark.read.parquet(str(out)).collect()
    assert sorted((x.task_id, x.daily_hours) for x in got) == [("t1", 8.0), ("t2", 4.0), ("t2", 8.0), ("t3", 8.0), ("t4", 8.0)]
    # a state that was lost, or is past its time, leaves the table to decide
    feed.start_feed(spark, str(src), str(out), str(tmp_path / "other")).awaitTermination(120)
    again = spark.read.parquet(str(out)).select(*feed.DEDUP_KEYS)
    assert again.count() == again.distinct().count() == 5
    assert sorted(p.name for p in out.iterdir() if p.is_dir()) == ["start_month=2024-01", "start_month=2024-02", "start_month=none"]
    schema = feed.labour_stream(spark, str(src)).schema.add("batch_id", "string")
    plan = feed.table(spark, str(out), schema).filter(F.col(feed.MONTH).isin(["2024-02"]))
    assert all("start_month=2024-02" in f for f in plan.select(F.input_file_name()).toPandas().iloc[:, 0])


# -- J8 on lines ------------------------------------------------------------

def test_lines_merge_first_with_first(spark):
    a = spark.createDataFrame([("q1", 2, "b"), ("q1", 1, "a"), ("q2", 1, "c"), (None, 1, "n")], "k string, o int, v string")
    b = spark.createDataFrame([("q1", 5, "x"), ("q3", 1, "y"), ("q1", 6, "z"), ("q1", 7, "w"), (None, 1, "m")], "k string, o int, v string")
    got = joins.aligned_merge(a, b, ["k"], left_order=["o"], right_order=["o"], columns={"l": F.col("l.v"), "r": F.col("r.v")}, tag=("s", "A", "B"))
    assert sorted([tuple(x) for x in got.collect()], key=str) == sorted(
        [("q1", 0, "a", "x", "B"), ("q1", 1, "b", "z", "B"), ("q1", 2, None, "w", "B"), ("q2", 0, "c", None, "A"),
         ("q3", 0, None, "y", "B"), (None, 0, "n", None, "A"), (None, 0, None, "m", "B")], key=str)


def test_occurrences_of_a_hot_key_are_numbered_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("IF(id % 10 < 7, 'hot', CAST(id % 3 AS STRING)) AS k", "id AS o", "CAST(id AS STRING) AS v").repartition(13)
    got = joins.occurrences(df, ["k"], ["o"])
    seen = {}
    for x in sorted(got.collect(), key=lambda x: x.o):
        assert x.occurrence == seen.get(x.k, 0)
        seen[x.k] = x.occurrence + 1
    assert seen["hot"] == 3500


# -- G3, D5 -----------------------------------------------------------------

def test_names_take_the_first_free_suffix(spark):
    rows = [(["a", "a", "a_1"], ["a", "a_1", "a_1_1"]), (["a", "a_1", "a", "a"], ["a", "a_1", "a_2", "a_3"]), ([], []), (["x"] * 4, ["x", "x_1", "x_2", "x_3"])]
    df = spark.createDataFrame([(r,) for r, _ in rows], "r array<string>")
    assert [x[0] for x in df.select(G.first_free(F.col("r"))).collect()] == [w for _, w in rows]


def test_a_registered_parser_gets_its_sheets(spark):
    docs = spark.createDataFrame([("s1", "a,b\n1,2\n3,4"), ("s2", "x\ny"), ("s3", "k|v"), ("s4", "a,b\n1,2"), ("s5", "")], "doc string, text string")
    grid = G.grid_from_text(docs, sheet="doc", text="text")
    choices = spark.createDataFrame([("s1", "standard"), ("s2", "upper"), ("s3", "upper"), ("s4", "nobody"), ("s5", "standard")], "sheet string, parser string")
    parsers = default_parsers()
    parsers.register("upper", lambda g: g.select("sheet", F.lit(7).cast("long").alias("table_no"), "row_idx",
                                                 F.transform("cells", lambda c: F.upper(c)).alias("values")))
    rows, summary = parsers.parse_sheets(grid, choices)
    assert sorted((x.sheet, x.row_idx, x["values"]) for x in rows.filter("parser = 'upper'").collect()) == [
        ("s2", 0, ["X"]), ("s2", 1, ["Y"]), ("s3", 0, ["K|V"])]
    assert {x.sheet: (x.n_rows, x.status) for x in summary.collect()} == {
        "s1": (2, "ok"), "s2": (2, "ok"), "s3": (1, "ok"), "s4": (0, "failed"), "s5": (0, "failed")}
    with pytest.raises(TypeError):
        parsers.register("no", "function")


# -- R15, R10 ---------------------------------------------------------------

def test_uses_are_compacted_whatever_is_sent_twice(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "query_name string, user_email string, last_used_at timestamp, use_id long, batch string"
    first = [("q", "u", day(1), 1, "a"), ("q", "u", day(3), 2, "a"), ("q", None, day(1), 3, "a")]
    second = [("q", "u", day(2), 4, "b"), ("p", "u", day(9), 5, "b"), ("q", "u", day(3), 6, "b")]
    path = f"{tmp_path}/log"
    for rows in (first, second, first):
        R.append_uses(spark.createDataFrame(rows, schema), path)
    log = R.read_uses(spark, path, spark.createDataFrame([], schema).schema)
    want = {("q", "u", day(3), 6, 4), ("q", None, day(1), 3, 1), ("p", "u", day(9), 5, 1)}
    assert {tuple(x) for x in R.compact_uses(log).collect()} == want
    base = R.compact_uses(log.filter("batch = 'a'"))
    assert {tuple(x) for x in R.compact_uses(log.filter("batch = 'b'"), base).collect()} == want
    saved = spark.createDataFrame([("q",), ("never",), ("p",)], "name string")
    listed = R.queries_by_last_use(saved, R.compact_uses(log), place="place")
    assert [x.name for x in listed.orderBy("place").collect()] == ["p", "q", "never"]


def test_the_pattern_filter_binds_its_lists(spark):
    df = spark.createDataFrame([("Variation 1",), ("private VO",), ("avocado",), ("it's",), (None,)], "ref string")
    get = lambda *x: sorted(r.ref for r in R.filter_table(spark, df, "ref", *x).collect())
    assert get(["%vo%", "%variation%"], ["%avo%"]) == ["Variation 1", "private VO"]
    assert get(["it's"]) == ["it's"] and get([]) == [] and get(["%' OR 1=1 --"]) == []
    with pytest.raises(ValueError):
        R.filter_table(spark, df, "ref; drop", ["%"])


# -- G5, G7, G9, G11, S10 ---------------------------------------------------

def test_column_letters(spark):
    n = [1, 26, 27, 52, 53, 702, 703, 18_278]
    df = spark.createDataFrame([(x,) for x in n], "n int").select(G.column_letters(F.col("n")))
    assert [x[0] for x in df.collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]


def test_tables_are_checked_for_columns_and_number(spark):
    docs = spark.createDataFrame([("one", "a,b\n1,2"), ("two", "a,b\n1,2\n\n\n\na,c\n3,4\n5,6")], "doc string, text string")
    g = G.grid_from_text(docs, sheet="doc", text="text")
    found = G.segment_tables(g)
    heads = G.table_rows(g).select("sheet", "table_no", "headers").distinct()
    got = {(x.sheet, x.table_no, x.check): (x.passed, x.observed) for x in G.expectations(found, headers=heads, required=["a", "b"], min_tables=2).collect()}
    assert got["two", 0, "required_columns"] == (True, 0) and got["two", 1, "required_columns"] == (False, 1)
    assert got["one", None, "min_tables"] == (False, 1) and got["two", None, "min_tables"] == (True, 2)
    ranges = {(x.sheet, x.table_no): x.range for x in G.a1_ranges(g, G.detect_ranges(g)).collect()}
    assert sorted(ranges.values()) == ["one!A1:B2", "two!A1:B2", "two!A6:B8"]


def test_each_report_is_read_by_its_own_header(spark, tmp_path):
    from tradeflow.sources import io
    (tmp_path / "a.csv").write_text("x\nDate,Debit,Note\n1 Jan 2024,5,a\n")
    (tmp_path / "b.csv").write_text("x\nNote,Date,Debit\n\"b, c\",2 Feb 2024,7\n")
    got = sorted(tuple(r) for r in io.read_ledger_report(spark, str(tmp_path), skip_rows=1).collect())
    assert got == [(dt.date(2024, 1, 1), "5", "a"), (dt.date(2024, 2, 2), "7", "b, c")]
    (tmp_path / "c.csv").write_text("x\nDate,Debit\n1 Jan 2024,5\n")
    with pytest.raises(ValueError, match="c.csv"):
        io.read_ledger_report(spark, str(tmp_path), skip_rows=1)


def test_errors_of_the_data_are_not_taken_for_a_refused_table(spark, tmp_path):
    from tradeflow.sources import io
    bad = spark.range(3).select(F.raise_error(F.lit("broken row")).alias("x"))
    with pytest.raises(Exception, match="broken row"):
        io.save_to(bad, "broken", ["catalog", "files"], str(tmp_path))

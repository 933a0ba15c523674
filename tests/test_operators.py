import datetime as dt
import random
import re

from pyspark.sql import functions as F

from bruteforce import contains_pairs, greedy_groups, phrase_pairs
from tradeflow.functions import text as X
from tradeflow.operators import graph, link, quotes as Q
from tradeflow.operators.aggregate import exact_median_and_mean


def _py_clean_address(a):
    x = a.split(",")[0].strip()
    for s in X.STREET_SUFFIXES:
        x = x.removesuffix(s)
    return x.strip()


def _py_multi(a):
    m = re.match(r"(\d+)[a-zA-Z]*[\/\-]?(\d*)\s*(.*)", a)
    if m:
        return f"{m.group(2)} {m.group(3)}" if m.group(2) else f"{m.group(1)} {m.group(3)}"
    return a


def test_address_functions_match_python(spark):
    rows = ["12 Foo Street, Bar", "3 Baz Rd", "7 Qux St.", "1/39B Middleton Road", "39a Middleton",
            "  5 Lane Lane  ", "No number St", "10 Main St Street", "2-4 Hill Ave, Town, X", ""]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    out = df.select("a", X.clean_address_suffix("a").alias("c"), X.clean_multi_address("a").alias("m"),
                    X.suburb("a").alias("s")).collect()
    for r in out:
        assert r.c == _py_clean_address(r.a), r
        assert r.m == _py_multi(r.a), r
        assert r.s == (r.a.split(", ")[1] if "," in r.a and ", " in r.a else r.s)


def test_percentage_parity(spark):
    df = spark.createDataFrame([("sewer 12.5% of",), ("gully 15%",), ("100% done",), ("5% only",), (None,),
                                ("none",)], "t string")
    got = [r.p for r in df.select(X.pct_from_text("t").alias("p")).collect()]
    assert got == [0.125, 0.15, 0.0, 1.0, 1.0, 1.0]


def test_serial_dates_and_money(spark):
    df = spark.createDataFrame([("44927", "1,234.50"), ("1", "-5"), ("", "1.5d"), ("invalid", "invalid"),
                                (None, None), ("44927.0", " 7 ")], "d string, m string")
    got = df.select(X.serial_to_date("d").alias("d"), X.money_to_double("m").alias("m")).collect()
    assert got[0].d == dt.date(2023, 1, 1) and got[0].m == 1234.5
    assert got[1].d == dt.date(1899, 12, 31) and got[1].m == -5.0
    assert got[2].d is None and got[2].m is None
    assert got[3].d is None and got[3].m is None
    assert got[4].d is None and got[4].m is None
    assert got[5].d is None and got[5].m == 7.0


def test_attachment_classes(spark):
    urls = ["https://trello.com/1/cards/x/attachments/y/download/photo.jpg", "https://trello.com/c/abc123/card",
            "https://trello.com/b/xyz", "https://drive.google.com/drive/folders/1",
            "https://drive.google.com/x?usp=drive_link", "https://docs.google.com/d/1", "https://go.xero.com/q",
            "https://example.com/x", "https://trello.com/1/x/noname"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.k for r in df.select(X.attachment_class("u").alias("k")).collect()]
    assert got == ["pictures", "linked_cards", "other_links", "drive_folder", None, "documents", "financials",
                   "other_links", None]


def _rand_word(rng):
    return rng.choice(["12", "3", "main", "st", "brand#2", "brand#21", "a.b", "x(y)", "élan", "foo_bar", "-"])


def test_phrase_join_equals_bruteforce(spark):
    rng = random.Random(7)
    names = [(i, " ".join(_rand_word(rng) for _ in range(rng.randint(1, 2)))) for i in range(40)]
    names += [(100, "#"), (101, "12 Main")]
    texts = [(j, " ".join(_rand_word(rng) for _ in range(rng.randint(1, 6))) + rng.choice(["", ",", " st."]))
             for j in range(200)] + [(900, None), (901, "12 MAIN street")]
    n = spark.createDataFrame(names, "id long, n string")
    t = spark.createDataFrame(texts, "tid long, t string")
    pairs, _ = link.phrase_join(n, t, name_id="id", name_col="n", text_id="tid", text_col="t")
    got = {(r.id, r.tid) for r in pairs.collect()}
    assert got == phrase_pairs(names, texts)
    assert (101, 901) in got


def test_contains_join_equals_bruteforce(spark):
    rng = random.Random(3)
    alphabet = "ab1 #"
    names = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(99, "")]
    texts = [(j, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for j in range(150)]
    n = spark.createDataFrame(names, "id long, n string")
    t = spark.createDataFrame(texts, "tid long, t string")
    got = {(r.id, r.tid) for r in link.contains_join(n, t, needle_id="id", needle_col="n", text_id="tid",
                                                     text_col="t").collect()}
    assert got == contains_pairs(names, texts)


def test_greedy_groups_equal_sequential_scan(spark):
    rng = random.Random(11)
    for trial in range(3):
        jobs = [f"j{i:02d}" for i in range(25)]
        shared = [j for j in jobs if rng.random() < 0.6]
        links = {s: rng.sample(jobs, rng.randint(0, 3)) for s in shared}
        links = {k: [t for t in v if t != k] for k, v in links.items()}
        nodes = spark.createDataFrame([(s, jobs.index(s)) for s in shared], "name string, ord long")
        alljobs = spark.createDataFrame([(j,) for j in jobs], "name string")
        edges = spark.createDataFrame([(k, t) for k, v in links.items() for t in v] or [("x", "y")],
                                      "src string, dst string")
        got = graph.greedy_groups(nodes, alljobs, edges).collect()
        got_groups = {}
        for r in got:
            got_groups.setdefault(r.project, []).append(r.name)
        exp = greedy_groups(shared, links, set(jobs))
        assert {k: sorted(v) for k, v in got_groups.items()} == exp


def test_connected_components(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "name string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("g", "g")], "src string, dst string")
    got = {r.name: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}


def test_all_quote_categories_match_python_re(spark):
    lines = ["Remove and replace sewer pipe", "Remove and replace stormwater and sewer", "Shared trench dig",
             "Remove and replace concrete path", "Remove and replace pavers with concrete", "timber deck repair",
             "Pipelining deck", "relay pavers", "Install blueline watermain", "Double cut driveway",
             "uplift pavers not set", "Pipelining then pavers set", "AP20/40 fill", "nothing here"]
    df = spark.createDataFrame([(f"q{i}", t, 1.0, 2.0) for i, t in enumerate(lines)],
                               "quote_no string, item_desc string, line_pct double, quantity double")
    got = {(r.quote_no, r.category) for r in Q.quote_category_quantities(df).collect()}
    exp = {(f"q{i}", k) for i, t in enumerate(lines) for k, _, pat, _ in Q.QUOTE_CATEGORIES if re.search(pat, t)}
    assert got == exp


def test_exact_median(spark):
    for vals in ([1, 2, 3, 10], [5], [3, 1, 2], [4, 4, 4, 9, 9]):
        df = spark.createDataFrame([(v,) for v in vals], "d int")
        r = exact_median_and_mean(df, "d").collect()[0]
        s = sorted(vals)
        mid = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        assert r["median"] == mid and r["mean"] == round(sum(vals) / len(vals), 2)

"""Cases in which rows, columns or groups were once lost."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tradeflow.operators import graph, link, quotes as Q, reports as R
from tradeflow.sources import grid as G, io, nested as N
from tradeflow.streaming.labour_feed import start_feed


def test_components_of_long_paths_need_few_rounds(spark):
    n = 1500
    nodes = spark.range(2 * n + 3).select(F.col("id").alias("name"))
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(n + i, n + i + 1) for i in range(n - 1)]
    got = graph.connected_components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.component for r in got if r.name < n} == {0} and {r.component for r in got if n <= r.name < 2 * n} == {n}
    assert {r.component for r in got if r.name >= 2 * n} == {2 * n, 2 * n + 1, 2 * n + 2}
    assert graph.connected_components.rounds <= 20


def test_components_match_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = graph.connected_components(spark.range(300).withColumnRenamed("id", "name"),
                                     spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {x.name: x.component for x in got} == {i: find(i) for i in range(300)}


def test_greedy_groups_of_a_long_chain_lose_no_job(spark):
    n = 60
    jobs = spark.createDataFrame([(f"j{i:03}", i) for i in range(n)], "name string, ord int")
    edges = spark.createDataFrame([(f"j{i:03}", f"j{i + 1:03}") for i in range(n - 1)], "src string, dst string")
    members = graph.greedy_groups(jobs, jobs, edges).collect()
    assert {m.name for m in members} == {f"j{i:03}" for i in range(n)}
    assert len({m.project for m in members}) == n // 2


def write_json(folder, name, rows):
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))


def test_late_bookings_arrive_and_replays_change_nothing(spark, tmp_path):
    src, out, check = (tmp_path / x for x in ("in", "out", "check"))
    src.mkdir()
    base = {"name": "1 Foo", "employee": "E", "start_date": "2024-01-01", "end_date": "2024-01-01", "daily_hours": 8.0}
    write_json(src, "a", [{**base, "task_id": "t1", "exported_at": "2024-01-10T00:00:00"}])
    start_feed(spark, str(src), str(out), str(check)).awaitTermination(120)
    write_json(src, "b", [{**base, "task_id": "t2", "exported_at": "2024-01-05T00:00:00"},
                          {**base, "task_id": "t1", "exported_at": "2024-01-11T00:00:00"},
                          {**base, "task_id": "t3", "employee": None, "exported_at": "2023-01-04T00:00:00"}])
    start_feed(spark, str(src), str(out), str(check)).awaitTermination(120)
    names = lambda: sorted(r.task_id for r in spark.read.parquet(str(out)).collect())
    assert names() == ["t1", "t2", "t3"]
    # a crash before the commit of batch 1 replays it
    for folder in ("commits",):
        for f in (check / folder).glob("*1*"):
            f.unlink()
    start_feed(spark, str(src), str(out), str(check)).awaitTermination(120)
    assert names() == ["t1", "t2", "t3"]
    write_json(src, "c", [{**base, "task_id": "t3", "employee": None, "exported_at": "2024-02-04T00:00:00"}])
    start_feed(spark, str(src), str(out), str(check)).awaitTermination(120)
    assert names() == ["t1", "t2", "t3"]


def test_columns_whose_names_begin_like_made_up_ones_stay(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,_code,name,, \n1,a,"b, c",z,y\n2,,d,z,y\n')
    df = io.read_csv_filled(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["id", "_code", "name"] and [tuple(r) for r in df.collect()] == [("1", "a", "b, c"), ("2", "", "d")]


def test_ledger_report_keeps_quoted_commas_and_skips_rows_per_file(spark, tmp_path):
    head = "Ledger\nx\n\nPrinted,today\nDate,Debit,Note\n"
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(head + f'1 Jan 2024,"1,234.5{k}",a\n2 Feb 2024,5,"b, ""c"""\nTotal,,\n')
    got = sorted(tuple(r) for r in io.read_ledger_report(spark, str(tmp_path)).collect())
    assert got == sorted([(dt.date(2024, 1, 1), f"1,234.5{k}", "a") for k in range(3)]
                         + [(dt.date(2024, 2, 2), "5", 'b, "c"')] * 3)


def test_quotes_without_a_status_stay(spark):
    page = {"Quotes": [
        {"QuoteNumber": "Q1", "LineItems": [{"LineItemID": "1", "Description": "x at 12.5%", "Quantity": 1.0}]},
        {"QuoteNumber": "Q2", "Status": "DELETED", "LineItems": [{"LineItemID": "2"}]},
        {"QuoteNumber": "Q3", "Status": "SENT", "LineItems": []}]}
    lines, errors = N.quote_lines_from_json(spark.createDataFrame([(json.dumps(page),)], "json string"))
    assert [(r.quote_no, r.line_pct) for r in lines.collect()] == [("Q1", 0.13)]
    found = {(r.quote_no, r.line_id, r.error) for r in errors.collect()}
    assert {("Q3", None, "no_line_items"), ("Q1", None, "no_reference"), ("Q1", "1", "no_ItemCode")} <= found
    assert not [f for f in found if f[0] == "Q2"] and "line_id" not in N.human_lines(lines).columns


def test_list_fields_with_a_value_are_null(spark):
    board = {"id": "b", "customFields": [{"id": "f", "name": "Kind", "type": "list", "options": [{"id": "o", "value": {"text": "T"}}]}],
             "cards": [{"id": "c1", "customFieldItems": [{"idCustomField": "f", "idValue": "o", "value": None}]},
                       {"id": "c2", "customFieldItems": [{"idCustomField": "f", "idValue": "o", "value": {"text": "own"}}]}]}
    df = spark.createDataFrame([(json.dumps(board),)], "j string").select(F.from_json("j", N.BOARD_SCHEMA).alias("b")).select("b.*")
    assert {r.card_id: r.value for r in N.custom_field_values(df).collect()} == {"c1": "T", "c2": None}
    wide = N.field_columns(N.custom_field_values(df), ["Kind", "spouting_done"])
    assert wide.columns == ["card_id", "kind"]


def test_sheets_without_cells_have_no_columns(spark):
    g = spark.createDataFrame([("s", 0, []), ("s", 1, []), ("t", 0, ["a", "a"]), ("t", 1, ["1", "2"])],
                              "sheet string, row_idx long, cells array<string>")
    assert {r.sheet: r.headers for r in G.detect_headers(g).collect()} == {"s": [], "t": ["a", "a_1"]}


def test_sub_tables_have_their_own_headers_and_rows(spark):
    cells = [["h1", "h2"], ["1", "2"], [""], ["3"], [""], [""], [""], ["x", "x", ""], ["5", "", "7"]]
    g = spark.createDataFrame([("s", i, c) for i, c in enumerate(cells)], "sheet string, row_idx long, cells array<string>")
    got = sorted((r.table_no, r.row_idx, r.headers, r["values"]) for r in G.table_rows(g).collect())
    assert got == [(0, 1, ["h1", "h2"], ["1", "2"]), (0, 3, ["h1", "h2"], ["3", None]),
                   (1, 8, ["x", "x_1", "column_2"], ["5", None, "7"])]


@pytest.mark.parametrize("sql", ["-- note\nDROP VIEW vv", "/* a */ -- b\n  create view x as select 1", "SET x=1", "",
                                 "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM t INSERT INTO u SELECT *"])
def test_only_queries_are_registered_and_checked(spark, sql):
    spark.range(1).createOrReplaceTempView("vv")
    assert R.register_report({}, "r", sql) is None and R.validate_report(spark, sql) == "not a query"
    assert spark.table("vv").count() == 1


@pytest.mark.parametrize("sql", ["-- drop it\nSELECT 'insert into x' AS a", "WITH a AS (SELECT 1 AS b) SELECT * FROM a",
                                 "(SELECT 1 AS a)", "FROM range(3) SELECT id", "/* x */ VALUES (1)"])
def test_queries_with_comments_pass(spark, sql):
    assert R.register_report({}, "r", sql) and (R.validate_report(spark, sql) is None or sql.startswith("FROM"))


def test_saved_queries_replace_by_name(spark):
    saved = spark.createDataFrame([("a", "SELECT 1"), ("b", "SELECT 2")], "name string, sql string")
    got = {r.name: r.sql for r in R.save_query(saved, "a", "SELECT 3").collect()}
    assert got == {"a": "SELECT 3", "b": "SELECT 2"}
    with pytest.raises(ValueError):
        R.save_query(saved, "c", "DROP TABLE x")


def test_samples_do_not_depend_on_the_partitions(spark):
    df = spark.range(5000)
    take = lambda d, seed: {r.id for r in R.sample_n(d, 100, "id", seed).collect()}
    assert take(df, 7) == take(df.repartition(13), 7) != take(df, 8)


def test_contains_candidates_stay_near_the_matches(spark):
    ratio = []
    for n in (400, 4000):
        names = spark.range(n).select(F.col("id").alias("_nid"), F.concat(F.col("id").cast("string"), F.lit(" Building")).alias("_nv"))
        texts = spark.range(n).select(F.col("id").alias("_tid"), F.concat(F.lit("part for "), F.col("id").cast("string"),
                                                                       F.lit(" Building")).alias("_tv"))
        cand = link.contains_candidates(names, texts)
        ratio.append(cand.count() / n)
    assert max(ratio) <= 4 and ratio[1] <= 1.5 * ratio[0]


def test_quote_exports_share_one_target(spark):
    a = spark.createDataFrame([("Q", "r", "c", "s", "d", "i", "0.5", "2", "3", "6", "2024-01-02", "drop me")],
                              "quote_no string, quote_ref string, customer string, quote_status string, item_desc string, "
                              "item_code string, line_pct string, quantity string, unit_price string, line_total string, "
                              "created string, quote_id string")
    b = spark.createDataFrame([("Q2", "site", "c", "x at 20%", 1, 2.0, 3.0, "2024-03-04")],
                              "quote_no string, site string, customer string, item string, quantity int, unit_price double, "
                              "total double, date_created string")
    rows = {r.quote_no: r for r in Q.union_quotes(Q.normalise_source_a(a), Q.normalise_source_b(b)).collect()}
    assert tuple(Q.normalise_source_a(a).columns) == Q.QUOTE_COLUMNS
    assert (rows["Q"].line_pct, rows["Q"].quantity, rows["Q"].created) == (0.5, 2.0, dt.date(2024, 1, 2))
    assert (rows["Q2"].quote_ref, rows["Q2"].line_pct, rows["Q2"].item_code, rows["Q2"].quote_source) == ("site", 0.2, "", "Simpro")

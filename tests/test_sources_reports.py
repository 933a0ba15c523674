import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from tradeflow.operators import quality as DQ, reports as R
from tradeflow.sources import grid as G, io


def _grid(spark, sheets):
    rows = [(s, i, cells) for s, grid in sheets.items() for i, cells in enumerate(grid)]
    return spark.createDataFrame(rows, "sheet string, row_idx long, cells array<string>")


def test_grid_standard_offset_multi(spark):
    g = _grid(spark, {
        "standard": [["Date", "Amount", " Note "], ["1", "2", "3"], ["4", "", "6"], ["7", "8", "9"]],
        "offset": [["", "", ""], ["A", "B", "A"], ["1", "2"], ["3", "4", "5"], ["7", "8", "", ""]],
        "multi": [["h1", "h2"], ["1", "2"], ["3", "4"], [""], [""], [""], ["x", "y"], ["5", "6"], ["7", "8"]],
        "two_blank": [["a"], ["1"], [""], [""], ["2"]],
    })
    h = {r.sheet: r for r in G.detect_headers(g).collect()}
    assert h["standard"].header_row == 0 and h["standard"].headers == ["Date", "Amount", "Note"]
    assert h["offset"].header_row == 1 and h["offset"].headers == ["A", "B", "A_1", "column_3"] and h["offset"].n_cols == 4
    t = {(r.sheet, r.table_no): (r.start_row, r.end_row, r.n_rows) for r in G.segment_tables(g).collect()}
    assert t[("multi", 0)] == (0, 2, 3) and t[("multi", 1)] == (6, 8, 3)
    assert t[("two_blank", 0)] == (0, 4, 3)
    rows, _ = G.normalise_rows(g, G.detect_headers(g))
    off = sorted((r.row_idx, r["values"]) for r in rows.filter("sheet = 'offset'").collect())
    assert off == [(2, ["1", "2", None, None]), (3, ["3", "4", "5", None]), (4, ["7", "8", None, None])]


def test_truncation_suspicion(spark):
    df = spark.createDataFrame([(0,), (5,), (999,), (1000,), (500,), (13005,)], "n long")
    got = [r.s for r in df.select(G.truncation_suspect(F.col("n")).alias("s")).collect()]
    assert got == [False, True, True, True, False, True]


def test_report_registry_and_params(spark):
    reg = {}
    assert R.register_report(reg, "drop_it", "DROP TABLE x") is None
    assert R.register_report(reg, "loop", "SELECT {% for x in y %}1{% endfor %}") is None
    rep = R.register_report(reg, "after", "SELECT * FROM range(10) WHERE id > {{ n }}")
    assert rep.is_template and rep.variables == ["n"]
    df, err = R.run_report(spark, reg, "after", n=6)
    assert err is None and sorted(r.id for r in df.collect()) == [7, 8, 9]
    _, err = R.run_report(spark, reg, "after")
    assert "missing" in err
    assert R.validate_report(spark, "SELECT nope FROM range(1)") is not None
    try:
        R.register_report(reg, "bad name", "SELECT 1")
        raise AssertionError("identifier check")
    except ValueError:
        pass


def test_usage_order_never_used_last(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    log = spark.createDataFrame([("a", "u", dt.datetime(2024, 1, 1)), ("c", "u", dt.datetime(2024, 2, 1)),
                                 ("a", "v", dt.datetime(2024, 3, 1))],
                                "query_name string, user_email string, last_used_at timestamp")
    assert [r.name for r in R.queries_by_last_use(q, log).collect()] == ["a", "c", "b"]
    assert R.last_used(log).count() == 3


def test_sinks_and_status(spark):
    out = tempfile.mkdtemp(prefix="tf-sink-", dir="/tmp")
    df = spark.createDataFrame([(1, "a", 1.5)], "id int, name string, value double")
    assert io.save_to(df, "roundtrip", ["files"], out) == ["files"]
    parts = [f for f in os.listdir(f"{out}/roundtrip") if f.endswith(".parquet")]
    biggest = max(parts, key=lambda f: os.path.getsize(f"{out}/roundtrip/{f}"))  # skip empty partitions
    back = io.read_by_suffix(spark, f"{out}/roundtrip/{biggest}")
    assert back.collect()[0].value == 1.5
    st = {r.table: (r.n_rows, r.missing) for r in io.status(spark, {"roundtrip": back, "gone": None}).collect()}
    assert st == {"roundtrip": (1, False), "gone": (None, True)}
    try:
        io.read_by_suffix(spark, "x.xlsx")
        raise AssertionError("suffix check")
    except ValueError:
        pass


def test_quality_suite(spark):
    q = spark.createDataFrame([("Xero", 10.0), ("Xero", -1.0), ("Simpro", 0.0)], "quote_source string, line_total double")
    rows, summary = DQ.suite(DQ.quote_checks(q))
    got = {r.check: (r.passed, r.observed) for r in rows.collect()}
    assert got["negative_totals_pct"] == (False, 33.33) and got["source_skew_pct"][0] is True
    assert summary.collect()[0].n_errors == 0


def test_labour_stream_dedups(spark):
    from tradeflow.streaming.labour_feed import start_feed
    src = tempfile.mkdtemp(prefix="tf-feed-", dir="/tmp")
    rec = {"task_id": "t1", "name": "1 Foo", "employee": "E", "start_date": "2024-01-01", "end_date": "2024-01-02",
           "daily_hours": 8.0, "exported_at": "2024-01-03T00:00:00"}
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps(rec) + "\n" + json.dumps(rec) + "\n" + json.dumps({**rec, "daily_hours": 4.0}) + "\n")
    out = tempfile.mkdtemp(prefix="tf-feed-out-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="tf-feed-ck-", dir="/tmp")
    q = start_feed(spark, src, out + "/labour", ck)
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/labour").collect()
    assert sorted(r.total_hours for r in got) == [8.0, 16.0]

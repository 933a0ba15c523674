"""A registry of table parsers and the routing of tagged sheets to them.

A parser is a function from grid rows (sheet, row_idx, cells) of any number of
sheets to table rows (sheet, table_no, row_idx, values). ``parse_sheets`` sends
each sheet to the parser that a table of choices names, all in one job, and
counts what came out per sheet. A sheet without rows, or whose parser is not
registered, is reported as failed instead of raising.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeflow.sources import grid as G

Parser = Callable[[DataFrame], DataFrame]
COLUMNS = ["sheet", "table_no", "row_idx", "values"]


def standard(grid: DataFrame, fixed_row: int | None = None) -> DataFrame:
    """One table under the detected header (or under the 1-based ``fixed_row``)."""
    rows, _ = G.normalise_rows(grid, G.detect_headers(grid, fixed_row=fixed_row))
    return rows.withColumn("table_no", F.lit(0).cast("long"))


def offset(grid: DataFrame) -> DataFrame:
    """One table whose header is the second row."""
    return standard(grid, fixed_row=2)


def multi(grid: DataFrame) -> DataFrame:
    """The non-blank rows of every table that blank rows set apart, header rows included."""
    tables = G.segment_tables(grid).filter("n_rows > 0").alias("t")
    rows = G.row_stats(grid).filter("n_filled > 0").alias("g")
    inside = (F.col("g.sheet") == F.col("t.sheet")) & F.col("g.row_idx").between(F.col("t.start_row"), F.col("t.end_row"))
    return rows.join(tables, inside).select("g.sheet", "t.table_no", "g.row_idx", F.col("g.cells").alias("values"))


class Parsers:
    """Parsers by name. ``paged`` names those whose row counts show whether a page limit cut the sheet."""

    def __init__(self, parsers: Mapping[str, Parser] | None = None, paged: tuple[str, ...] = ()):
        self._parsers, self._paged = dict(parsers or {}), set(paged)

    def register(self, name: str, parser: Parser, *, paged: bool = False) -> None:
        """Adds a parser, or replaces the one of that name."""
        if not callable(parser):
            raise TypeError(f"{name}: a parser is a function of a DataFrame")
        self._parsers[name] = parser
        (self._paged.add if paged else self._paged.discard)(name)

    def names(self) -> list[str]:
        return sorted(self._parsers)

    def parse_sheets(self, grid: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows (parser, sheet, table_no, row_idx, values), summary (sheet, parser, n_rows, status, truncation_suspect)).
        ``choices`` (sheet, parser): one row per sheet."""
        tagged = grid.select("sheet", "row_idx", "cells").join(choices.select("sheet", "parser"), "sheet")
        rows = None
        for name in self.names():
            own = self._parsers[name](tagged.filter(F.col("parser") == name).drop("parser")).select(F.lit(name).alias("parser"), *COLUMNS)
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            rows = tagged.select("parser", "sheet", F.lit(0).cast("long").alias("table_no"), "row_idx", F.col("cells").alias("values")).limit(0)
        n = F.coalesce("n", F.lit(0)).alias("n_rows")
        per = choices.select("sheet", "parser").join(rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")), "sheet", "left").select("sheet", "parser", n)
        suspect = F.col("parser").isin(*self._paged) & G.truncation_suspect(F.col("n_rows")) if self._paged else F.lit(False)
        return rows, per.select("*", F.when(F.col("n_rows") > 0, "ok").otherwise("failed").alias("status"), suspect.alias("truncation_suspect"))


def default_parsers() -> Parsers:
    return Parsers({"standard": standard, "offset": offset, "multi": multi, "paginated": standard}, paged=("paginated",))

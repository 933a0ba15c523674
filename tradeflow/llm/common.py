"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: its lineage is cut,
    only the columns a later step needs are read, and every reader gets the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(col: Column | str) -> Column:
    """Text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over dicts of Arrow columns; ``fn`` yields dicts of lists or arrays."""
    out = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(out)
        for made in fn({n: b.column(n) for n in b.schema.names} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def running(df: DataFrame, group: list[str], block: str, order: list[Column], measures: dict[str, Column],
            ) -> DataFrame:
    """Exclusive running sums per ``group`` in the order (block, order) without a group in one task.

    ``block`` splits each group; sums per (group, block) are added up over that
    small table, and only the rows of one block meet in a window. The columns
    of ``group`` and ``block`` hold no nulls.
    """
    from pyspark.sql import Window
    # dealt by the block too: an earlier exchange by the group alone would leave a large group in one task
    df = df.repartition(*group, block)
    per = df.groupBy(*group, block).agg(*[F.sum(m).alias(f"_b_{n}") for n, m in measures.items()])
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1) \
        if group else Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, block, *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
                                      for n in measures])
    inner = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"_i_{n}": F.coalesce(F.sum(m).over(inner), F.lit(0)) for n, m in measures.items()})
    joined = rows.join(per, [*group, block])
    return joined.withColumns(
        {n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in measures}).drop(
        *[f"_i_{n}" for n in measures], *[f"_o_{n}" for n in measures])


def if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A broadcast hint if a count proves at most ``rows`` rows (of fixed width); else Spark's own choice of join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

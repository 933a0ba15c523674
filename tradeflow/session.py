"""Session helpers: building a session, reliable checkpoints.

Nothing here is specific to one table. The library never sets cluster
configuration on its own except where a setting is missing in a local
session (tests, bench), see :func:`checkpoint_dir`.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tradeflow") -> SparkSession:
    """Session used by the bench and the scripts.

    On a cluster the master and resources come from spark-submit, and nothing
    set there is overridden; without them we default to
    ``local[BENCH_CPUS or 8]``. AQE stays on: it coalesces small shuffle
    partitions, splits skewed join partitions and may turn a sort-merge join
    into a broadcast one from runtime sizes.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    given = SparkConf()  # what spark-submit and spark-defaults have set
    local = {"spark.master": master or f"local[{cpus}]",
             "spark.driver.memory": os.environ.get("TRADEFLOW_DRIVER_MEMORY", "16g")}
    if given.get("spark.master", local["spark.master"]).startswith("local"):
        local["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus) * 2)
    always = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
              "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(app_name)
    for key, value in (always | local).items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder and make sure the context uses it.

    Order: the session's ``spark.checkpoint.dir`` (the shared folder a
    cluster names), then a folder already set on the context. Only a local
    master with neither gets a fresh scratch folder, as tests do; a cluster
    without the setting is an error because a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if current:
        return current
    if sc.master.startswith("local"):
        scratch = tempfile.mkdtemp(prefix="tradeflow-ckpt-", dir="/tmp")
        sc.setCheckpointDir(scratch)
        return sc.getCheckpointDir() or scratch
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What starts within runs with these settings; then the session's own are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go when the write that made them ends, not when the driver's garbage collector next runs.
CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below the shared checkpoint folder, reread: several readers share one computation, each
    reads only its columns, and a lost executor rereads instead of recomputing. In zstd, as texts stand beside each of
    their keys."""
    path = scratch_path(df.sparkSession, name)
    with settings(df.sparkSession, CLEAN_UP):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Takes away the files of a table that :func:`written` has made and that nobody reads any more."""
    jvm, paths = df.sparkSession._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in (jvm.org.apache.hadoop.fs.Path(p) for p in paths):
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


TASK_ROWS = 1 << 19  # rows that one task holds at once, about
BROADCAST_ROWS = 200_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as ``rows`` need, at least those of the session's shuffles."""
    return max(-(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as ``rows`` need; left alone where the session's shuffles have as many.
    What a task sorts then stays the same however large the tables are."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def tasks_in_need(spark: SparkSession, rows: int):
    """What is written within has as many shuffle tasks as ``rows`` need, which are not merged again; as it is where the
    session's shuffles have as many. Unlike rows that are dealt, those of an aggregate are folded before they move."""
    n, own = -(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return settings(spark, {"spark.sql.shuffle.partitions": str(n),
                            "spark.sql.adaptive.coalescePartitions.enabled": "false"} if n > own else {})


def counted(df: DataFrame) -> DataFrame:
    """A written table as one side of a join, by its count of rows: sent to all tasks if they are few, else sorted where the
    keys meet. Its size on disk, compressed, is a small part of what it takes in the memory of each task."""
    return df.hint("broadcast" if df.count() <= BROADCAST_ROWS else "merge")


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as the lookup side of a join (a row or few per key): sent to all tasks if its counted ``rows`` are few, else
    hashed where the keys meet, so that the large side is not sorted."""
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "shuffle_hash")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    Used by iterative operators so a lost executor re-reads the written
    state instead of replaying every round.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""The corpus pipeline: five stages over ``documents``, each one operator of ``tradeflow.llm``.

toxicity -> near copies -> benchmark passages -> mixture -> shards. Every
stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents (the last adds the shard); ``run`` writes
each stage's rows as Parquet in the shared folder and rereads them.

Rows with a null doc_id go by a key made from their text, so that they are
judged like any other. Rows that share a key share its fate, but for near
copies, where each of their texts is judged by itself.
Extra columns of ``docs`` pass through. An empty table gives an empty result.

The first two stages cannot be said in SQL, so there is no ORACLE_SQL; the
tests hold the stages against plain Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeflow.llm import decontaminate, mixing, sharding, simhash, toxicity
from tradeflow.llm.common import read, utf8, written

KEY = "_row_key"


def _key() -> Column:
    made = -F.pmod(F.xxhash64(utf8("text")), F.lit(1 << 62)) - 1
    return F.coalesce(F.col("doc_id"), made).alias(KEY)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(_key(), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row): the row as a struct, so that no column of it meets a name used here."""
    return docs.select(_key(), F.struct("*").alias("row"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return _keyed(docs).join(keys.select(KEY).distinct(), KEY, "left_anti").select("row.*")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go."""
    labels = read(spark, sf_dir, "labels").withColumnRenamed("doc_id", KEY)
    model, _ = toxicity.fit(_own(docs), labels, id_col=KEY)
    return docs.filter(model.score_column(utf8("text")) < 0.5)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one of the smallest key and text hash; its repeated rows
    collapse to one."""
    both = [KEY, "text_hash"]  # rows of one key may hold unlike texts
    text_hash = F.xxhash64(utf8("text")).alias("text_hash")
    groups = simhash.near_duplicates(docs.select(F.struct(_key(), text_hash).alias("of"), "text"), id_col="of")
    kept = written(groups.filter(F.col("of") == F.col("component_id")).select("of.*").groupBy(both).count(), "kept")
    keyed = docs.select(_key(), text_hash, F.struct("*").alias("row"))
    once = keyed.join(kept.filter("count = 1"), both, "left_semi")
    again = keyed.join(kept.filter("count > 1"), both, "left_semi").dropDuplicates(both)
    return once.unionByName(again).select("row.*")


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other parameters, go."""
    found = decontaminate.contaminated(_own(docs), read(spark, sf_dir, "benchmark"), id_col=KEY, exact_windows=True)
    return _without(docs, written(found.select(KEY).distinct(), "contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source as often as its weight asks for, within a budget of the corpus' own size."""
    return mixing.drawn_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it; a column of docs that has one of the added names gives way."""
    added = ["size", "text_crc32", "law", "shard", "slot"]
    # repeated draws of a document are equal rows: the n-th of them takes the n-th place
    number = lambda *order: F.row_number().over(Window.partitionBy(KEY, "crc").orderBy(*order))
    places = sharding.sharded(_own(docs), id_col=KEY).select(KEY, F.col("text_crc32").alias("crc"), *added)
    rows = docs.select(_key(), F.crc32(utf8("text")).alias("crc"), F.struct(docs.drop(*added).columns).alias("row"))
    return (rows.withColumn("n", number(KEY)).join(places.withColumn("n", number("shard", "slot")), [KEY, "crc", "n"])
            .select("row.*", *added))


STAGES = [("toxicity", civil), ("near_copies", near_copies), ("decontamination", unseen), ("mixture", mixture),
          ("shards", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

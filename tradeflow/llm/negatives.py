"""Hard negatives by BOND: a vertical scan over the dimensions of blocks of vectors.

The components are scaled and floored, so scores are whole numbers. Rows are
dealt by a hash into data blocks of about ``block`` rows, each packed into one
row as columns, one per dimension; within a block, rows are put in order by
repeated halving at the median of the widest dimension and cut into segments
of about ``segment`` rows, whose least and largest value per dimension are
kept. Anchors are packed into blocks in the same way, and each anchor block
meets each data block of its vector length, in a task for each data block or for a share of its anchors.

In a block an anchor starts from a bitmap (here the numbers of the set bits)
of the rows that may count, and reads the dimensions in descending order of
its own magnitude, ``step`` at a time. A row's score so far plus the least and
largest that its segment's remaining dimensions can add bound its score from
both sides; rows whose bounds rule them out leave the bitmap. What remains
after the last dimension has exact scores.

Two scans. Positives: rows of the anchor's label; a row goes when its upper
bound is under the k-th largest lower bound. Negatives: rows of other labels, for the
windows low * positive <= 100 * score <= high * positive; a row goes when its bounds
meet no window, or, in a window, are under the k-th largest lower bound of
rows surely inside. Of each block k rows per anchor and window are left, and
the first k of all blocks are chosen by (score descending, id).

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part. Equal rows (id, label and vector) count once; rows that
share an id are no others of each other. Vectors meet only vectors of their own
length. Scaled components beyond +-2^26 count as that bound, so that sums fit a
long. Fewer than k rows: all. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.llm.common import map_batches
from tradeflow.session import written

SCALE, LIMIT = 256, 1 << 26
BLOCK, ANCHORS, SEGMENT, STEP = 16_384, 512, 128, 8
TASKS = 2  # a core, at least, where there are blocks and anchor blocks for them
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
PACKED = "len int, block int, n int, ids binary, labels binary, marks binary, wanted binary, values binary"
NONE = -(1 << 63)  # no score


def scaled(vectors: DataFrame, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """(id, label, len, v, mark): the rows that take part, once each; ``mark`` tells rows of one id apart."""
    v = F.col("v")
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(fine)
            .select("id", "label", F.size(v).alias("len"), whole.alias("v")).dropDuplicates(["id", "label", "v"])
            .withColumn("mark", F.xxhash64("label", "v")))


def _halved(m: np.ndarray, size: int) -> np.ndarray:
    """An order of the columns of ``m`` in which runs of about ``size`` lie close together."""
    done, todo = [], [np.arange(m.shape[1])]
    while todo:
        rows = todo.pop()
        if len(rows) <= size or not m.shape[0]:
            done.append(rows)
            continue
        part = m[:, rows]
        widest = int(np.argmax(part.max(axis=1) - part.min(axis=1)))
        cut = np.argsort(part[widest], kind="stable")
        todo += [rows[cut[len(rows) // 2:]], rows[cut[:len(rows) // 2]]]
    return np.concatenate(done)


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """One row per block: its rows as columns of numbers, in the order of the halving. The blocks of a vector length
    are as many as its rows need; a row's block is the hash of its id and mark. ``wanted``: numbers that travel with a
    row, equally many for each."""
    per = rows.groupBy("len").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(per, "len").withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        n, length = t.num_rows, t["len"][0].as_py()
        order, out = np.arange(n), {"len": [length], "block": [t["block"][0].as_py()], "n": [n]}
        lists = {c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in t[c].chunks]).reshape(n, -1 if n else 0)
                 for c in ("v", "wanted")}
        m = lists["v"].T.astype(np.int32)
        order = _halved(m, SEGMENT)
        for c in ("id", "label", "mark"):
            out[f"{c}s"] = [t[c].to_numpy().astype(np.int64)[order].tobytes()]
        out |= {"wanted": [lists["wanted"][order].astype(np.int64).tobytes()], "values": [np.ascontiguousarray(m[:, order]).tobytes()]}
        schema = pa.schema([("len", pa.int32()), ("block", pa.int32()), ("n", pa.int32()),
                            *[(c, pa.binary()) for c in ("ids", "labels", "marks", "wanted", "values")]])
        return pa.table(out, schema=schema)

    if "wanted" not in rows.columns:
        dealt = dealt.withColumn("wanted", F.array().cast("array<bigint>"))
    return written(dealt.groupBy("len", "block").applyInArrow(pack, PACKED), name)


class Block:
    """A packed data block, and the scan of its columns."""

    def __init__(self, length: int, n: int, ids: bytes, labels: bytes, values: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.columns = np.frombuffer(values, np.int32).reshape(length, n).astype(np.int64)
        starts = np.arange(0, n, SEGMENT)
        self.segment = np.arange(n) // SEGMENT
        self.least = np.minimum.reduceat(self.columns, starts, axis=1)
        self.largest = np.maximum.reduceat(self.columns, starts, axis=1)

    def scan(self, q: np.ndarray, bitmap: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the set bits that ``keep(lower bounds, upper bounds)`` never drops."""
        order = np.argsort(-np.abs(q), kind="stable")
        rows = np.flatnonzero(bitmap)
        at_least, at_most = q[order, None] * self.least[order], q[order, None] * self.largest[order]
        low, high = np.minimum(at_least, at_most), np.maximum(at_least, at_most)
        # what is still to come after j dimensions, by segment
        low = np.concatenate((np.cumsum(low[::-1], axis=0)[::-1], np.zeros((1, low.shape[1]), np.int64)))
        high = np.concatenate((np.cumsum(high[::-1], axis=0)[::-1], np.zeros((1, high.shape[1]), np.int64)))
        score = np.zeros(len(rows), np.int64)
        for j in range(0, len(order) + 1, STEP):
            own = self.segment[rows]
            left = keep(score + low[min(j, len(order))][own], score + high[min(j, len(order))][own])
            rows, score = rows[left], score[left]
            if not len(rows):
                break
            for d in order[j:j + STEP]:
                score += q[d] * self.columns[d][rows]
        return rows, score

    def add(self, out: dict[str, list], anchor: int, mark: int, rows: np.ndarray, score: np.ndarray, k: int) -> int:
        """Adds the first k of the rows to ``out``; their number."""
        best = np.lexsort((self.ids[rows], -score))[:k]
        out["anchor_id"] += [anchor] * len(best)
        out["mark"] += [mark] * len(best)
        out["other"] += self.ids[rows[best]].tolist()
        out["score"] += score[best].tolist()
        return len(best)


def top(k: int):
    def keep(lower, upper):
        return upper >= (np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else np.iinfo(np.int64).min)
    return keep


def inside(ranges: list[tuple[int, int]], k: int):
    """Rows that may be among the first k of one of the ranges of scores (both ends included)."""
    def keep(lower, upper):
        left = np.zeros(len(lower), bool)
        for a, b in ranges:
            sure = lower[(lower >= a) & (upper <= b)]
            least = max(a, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else a
            left |= (upper >= least) & (lower <= b)
        return left
    return keep


def window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the largest s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def met(anchors: DataFrame, data: DataFrame) -> DataFrame:
    """Each anchor block beside each data block of its length, as single rows; anchors stay what they are, about 1 % of the
    rows. Written blocks are few and lie in few files, often one, so they are dealt out in turn, a block to a task; of fewer
    blocks than ``TASKS`` a core, copies are, each of which meets its share of the anchor blocks."""
    n = data.count()
    shares = max(1, -(-TASKS * data.sparkSession.sparkContext.defaultParallelism // max(n, 1)))
    per = anchors.groupBy("len").agg(F.max("block").alias("last"))
    copies = data.join(per, "len").withColumn("share", F.explode(F.sequence(F.lit(0), F.least("last", F.lit(shares - 1)))))
    blocks = max(1, copies.select("share").count())
    cells = copies.repartition(blocks).withColumn("a_block", F.explode(F.sequence("share", "last", F.lit(shares)))).drop("share", "last")
    own = anchors.select("len", F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in ("len", "block")])
    return cells.join(own, ["len", "a_block"])


def _cells(batches):
    """(anchor's (id, label, mark), its vector, its wanted numbers, the data block) of every cell."""
    for batch in batches:
        for i in range(len(batch["n"])):
            x = {c: batch[c][i].as_py() for c in batch}
            own, n = Block(x["len"], x["n"], x["ids"], x["labels"], x["values"]), x["a_n"]
            q = np.frombuffer(x["a_values"], np.int32).reshape(x["len"], n).astype(np.int64)
            ids, labels, marks = (np.frombuffer(x[f"a_{c}"], np.int64).tolist() for c in ("ids", "labels", "marks"))
            wanted = np.frombuffer(x["a_wanted"], np.int64).reshape(n, -1).tolist()
            yield own, [(ids[r], labels[r], marks[r], q[:, r], [w for w in wanted[r] if w != NONE]) for r in range(n)]


def _first(rows: DataFrame, k: int, by: list[str], other: str, score: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), other)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, *, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, anchor_block: int = ANCHORS,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on ``id``."""
    rows = written(scaled(vectors, label, id_col, vector_col, label_col), "vectors")
    data = packed(rows, block, "data-blocks").drop("marks", "wanted")
    anchors = packed(rows.filter(is_anchor), anchor_block, "anchor-blocks")

    def positive(batches):
        for own, anchors in _cells(batches):
            out = {c: [] for c in ("anchor_id", "mark", "other", "score")}
            for a, lab, mark, q, _ in anchors:
                own.add(out, a, mark, *own.scan(q, (own.labels == lab) & (own.ids != a), top(positives)), positives)
            yield out

    def negative(batches):
        for own, anchors in _cells(batches):
            out = {c: [] for c in ("anchor_id", "mark", "other", "score", "of")}
            for a, lab, mark, q, wanted in anchors:
                ranges = [window(s, low, high) for s in wanted]
                rows, score = own.scan(q, (own.labels != lab) & (own.ids != a), inside(ranges, negatives))
                for s, (least, most) in zip(wanted, ranges):
                    fit = (score >= least) & (score <= most)
                    out["of"] += [s] * own.add(out, a, mark, rows[fit], score[fit], negatives)
            yield out

    pairs = map_batches(met(anchors, data), positive, "anchor_id long, mark long, other long, score long")
    pairs = written(_first(pairs, positives, ["anchor_id", "mark"], "other", "score")
                    .select("anchor_id", "mark", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # an anchor's windows: one for each different score of its positives
    wanted = pairs.groupBy(F.col("anchor_id").alias("id"), "mark").agg(F.collect_set("positive_score").alias("w"))
    wanted = wanted.select("id", "mark", F.slice(F.concat("w", F.array_repeat(F.lit(NONE), positives)), 1, positives).alias("wanted"))
    asking = packed(rows.filter(is_anchor).join(wanted, ["id", "mark"]), anchor_block, "asking-blocks")
    found = map_batches(met(asking, data), negative, "anchor_id long, mark long, other long, score long, of long")
    found = _first(found, negatives, ["anchor_id", "mark", "of"], "other", "score").withColumnRenamed("of", "positive_score")
    return pairs.join(found, ["anchor_id", "mark", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

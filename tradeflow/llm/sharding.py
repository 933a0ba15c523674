"""Sharding by balanced label propagation over documents of equal text.

Law ``rows``: the shards' row counts differ by at most one. Linked documents
(equal texts) are first dealt round the shards in hash order. Then, in rounds
of Spark joins, the documents of a group that lie in other shards ask to move
to the shard where most of the group lies among those with room. Movement is
bounded by quotas for each pair of shards: as many may move one way as move
the other way, plus the room of the receiving shard. Within a quota, groups
move in hash order, and a group moves in part if the quota ends in it, so a
group larger than a shard fills one shard after another. Ties fall anew each
round, so that full shards find partners to exchange with. Rounds end when no
group is split, or nothing moved for ``IDLE_ROUNDS`` rounds (``max_rounds`` bounds the work, not the rows). Documents without
a copy cut no link wherever they go: they fill the shards up to their exact
counts.

The state is the number of a group's rows in each shard (at most one row per
group and shard), so a group with a third of all rows costs a few rows a
round. Ranks within a group or shard are running counts over hash blocks (see
``common.running``): no group and no shard is one task's work.

Defined results: a null text is an empty one, of size 1; empty texts are equal
texts. Rows with equal or null ids are rows of their own. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.llm.common import running, utf8, written
from tradeflow.session import cut_lineage

SHARDS, MAX_ROUNDS, IDLE_ROUNDS, BLOCKS = 16, 24, 3, 256
_GROUP = ["_g", "_crc", "_size"]


def _shard_of(position: Column, counts: list[int]) -> Column:
    """The shard of a position, when shards take ``counts`` positions in order."""
    out, upto = F.lit(None).cast("int"), sum(counts)
    for s in range(len(counts) - 1, -1, -1):
        out = F.when(position < upto, F.lit(s)).otherwise(out)
        upto -= counts[s]
    return out


def _quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move from shard to shard: exchanges, then the receiver's room."""
    left, out = list(room), {}
    for (a, b), n in sorted(asked.items()):
        swap = min(n, asked.get((b, a), 0))
        more = min(n - swap, left[b])
        left[b] -= more
        out[a, b] = swap + more
    return out


def propagate(groups: DataFrame, quota: list[int], max_rounds: int = MAX_ROUNDS, blocks: int = BLOCKS) -> DataFrame:
    """``(group, shard, n)``: where the rows of each group (with ``n`` rows) end."""
    shards = len(quota)
    dealt = running(groups.withColumn("_block", F.pmod(F.col("_g"), F.lit(blocks))), [], "_block",
                    [F.col(c) for c in _GROUP], {"_at": F.col("n")})
    part = F.array(*[F.struct(F.lit(s).alias("shard"), (F.floor((F.col("_at") + F.col("n") + shards - 1 - s) / shards)
                                                         - F.floor((F.col("_at") + shards - 1 - s) / shards))
                              .cast("long").alias("n")) for s in range(shards)])
    state = cut_lineage(dealt.select(*_GROUP, F.explode(part).alias("p")).select(*_GROUP, "p.*").filter("n > 0"))
    idle = 0
    for round_ in range(max_rounds):
        load = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [quota[s] - load.get(s, 0) for s in range(shards)]
        open_ = F.array(*[F.lit(r > 0) for r in room])
        rank = F.struct("n", F.xxhash64("_g", "shard", F.lit(round_)), "shard")  # ties fall anew each round
        # with every shard full, groups still meet by exchange
        able = F.element_at(open_, F.col("shard") + 1) if any(r > 0 for r in room) else F.lit(True)
        goal = state.groupBy(*_GROUP).agg(F.max(F.when(able, rank)).alias("to"), F.max(rank).alias("most"),
                                          F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        move = (state.join(goal.filter("to is not null"), _GROUP)
                .filter((F.col("shard") != F.col("to.shard")) & (rank < F.col("to")))
                .select(*_GROUP, "shard", F.col("to.shard").alias("to"), "n",
                        F.pmod(F.xxhash64(*_GROUP), F.lit(blocks)).alias("_block")))
        move = cut_lineage(move)
        asked = {(r["shard"], r["to"]): r["n"] for r in move.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        allowed = _quotas(asked, room)
        if not sum(allowed.values()):
            idle += 1
            if not asked or idle == IDLE_ROUNDS:
                break
            continue
        idle = 0
        table = F.create_map(*[F.lit(x) for (a, b), n in allowed.items() for x in (a * shards + b, n)])
        moved = (running(move, ["shard", "to"], "_block", [F.col(c) for c in _GROUP], {"_before": F.col("n")})
                 .withColumn("_m", F.greatest(F.lit(0), F.least(
                     F.col("n"), table[F.col("shard") * shards + F.col("to")] - F.col("_before"))))
                 .filter("_m > 0"))
        state = cut_lineage(state.unionByName(moved.select(*_GROUP, "shard", (-F.col("_m")).alias("n")))
                            .unionByName(moved.select(*_GROUP, F.col("to").alias("shard"), F.col("_m").alias("n")))
                            .groupBy(*_GROUP, "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    return state


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
            max_rounds: int = MAX_ROUNDS, blocks: int = BLOCKS) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard, copies)`` for every row."""
    text = utf8(text_col)
    size = (F.octet_length(text) + 1).cast("long")
    # rows without an id are dealt over the blocks one by one: their places are fixed as they are written
    spread = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = written(docs.select(F.col(id_col), F.xxhash64(text).alias("_g"), F.crc32(text).alias("_crc"),
                               size.alias("_size"), F.pmod(F.xxhash64(F.lit(9), F.col(id_col), spread), F.lit(blocks))
                               .alias("_block")), "rows")
    groups = written(rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")), "groups")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    linked = groups.filter("n > 1")
    placed = propagate(linked, quota, max_rounds, blocks)
    load = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    spare = [quota[s] - load.get(s, 0) for s in range(shards)]

    marked = rows.join(linked.select(*_GROUP, F.col("n").alias("copies")), _GROUP, "left")
    alone = running(marked.filter("copies is null"), [], "_block", [F.col(id_col)], {"_at": F.lit(1)})
    alone = alone.withColumn("shard", _shard_of(F.col("_at"), spare)).withColumn("copies", F.lit(1).cast("long"))
    ranked = running(marked.filter("copies is not null"), _GROUP, "_block", [F.col(id_col)], {"_at": F.lit(1)})
    parts = placed.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("parts"))
    pick = F.aggregate("parts", F.struct(F.col("_at").alias("left"), F.lit(-1).alias("shard")),
                       lambda acc, p: F.when(acc.left < 0, acc).otherwise(F.struct(
                           (acc.left - p.n).alias("left"),
                           F.when(acc.left < p.n, p.shard).otherwise(acc.shard).alias("shard"))))
    together = ranked.join(parts, _GROUP).withColumn("shard", pick.shard)
    cols = [id_col, *_GROUP, "_block", "shard", "copies"]
    placed_rows = written(alone.select(*cols).unionByName(together.select(*cols)), "placed")
    return running(placed_rows, ["shard"], "_block", [F.col(id_col)], {"slot": F.lit(1)}).select(
        id_col, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "copies")

"""Mixing sources to target weights by temperature.

The weight of a source is its token share raised to an exponent, normalised.
The exponent lies between 1 (the corpus as it is) and 0 (uniform); it is
bisected to the largest value whose weights reach ``target_entropy`` (a share
of the entropy of the uniform mixture), but not below the exponent at which a
source would be repeated more than ``max_repeats`` times within the budget.
Every round of the bisection is one aggregate over the table of sources that
tries 15 inner points at once.

Realisation: the documents of a source are dealt into ``blocks`` by a hash.
An epoch of a source is a pseudo-random permutation of its blocks. A source
gets as many whole epochs as its budget holds; of the next epoch it gets the
leading blocks that fit whole, then the documents of the block after them, in
hash order, as long as they fit. So no source exceeds its budget, and it falls
short by less than one document (or one group of repeated rows). A document's
copies follow from one row per source and hashes of its own id and text: the
corpus itself is neither sorted nor shuffled, however large one source is.

Defined results: a null source is a source; a null text is empty; empty texts
have no tokens and come along with their block; a source without any token has
weight 0 and no rows. Repeated rows are drawn together. Empty tables give an
empty result. Extra columns pass through ``drawn_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.llm.common import if_small, utf8, written

TARGET_ENTROPY, MAX_REPEATS, BUDGET, BLOCKS, SEED = 0.95, 4.0, 1.0, 1024, 20
_POINTS, _ROUNDS = 15, 11  # 16 ** -11 of the range is left


def token_count(text: str = "text") -> Column:
    """Words between white space."""
    return F.regexp_count(utf8(text), F.lit(r"\S+")).cast("long")


def _hash(*parts) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _keys(id_col: str, text_col: str, blocks: int, seed: int) -> dict[str, Column]:
    own = _hash(seed, F.col(id_col), utf8(text_col))
    return {"_block": F.pmod(own, F.lit(blocks)).cast("int"), "_order": _hash(seed + 1, own)}


def _turn(source: Column, epoch: Column, block: Column, seed: int) -> Column:
    """Blocks of an epoch follow each other by this key."""
    return _hash(seed + 2, source, epoch, block)


def exponent(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
             budget: float = BUDGET) -> float:
    """The exponent for ``totals`` (column ``tokens``, positive), bisected in Spark aggregates."""
    shares = totals.crossJoin(totals.agg(F.sum("tokens").alias("_all"))).select(
        (F.col("tokens") / F.col("_all")).alias("p"))

    def fits(points: list[float]) -> dict[float, tuple[bool, bool]]:
        a = F.explode(F.array(*[F.lit(x) for x in points])).alias("a")
        z = F.sum(F.pow("p", F.col("a")))
        rows = (shares.select("p", a).groupBy("a")
                .agg(z.alias("z"), F.sum(F.pow("p", F.col("a")) * F.log("p")).alias("l"),
                     F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.count(F.lit(1)).alias("n"))
                .select("a", (F.log("z") - F.col("a") * F.col("l") / F.col("z")).alias("h"), F.log("n").alias("top"),
                        (F.lit(budget) * F.col("most") / F.col("z")).alias("times")).collect())
        return {r.a: (r.h >= target_entropy * r.top - 1e-12, r.times <= max_repeats) for r in rows}

    def bisect(low: float, high: float, low_side) -> float:
        """``low_side`` is true of exponents up to a point; that point."""
        for _ in range(_ROUNDS):
            points = [low + (high - low) * k / (_POINTS + 1) for k in range(_POINTS + 2)]
            true = fits(points[1:-1])
            edge = max([0, *(k for k, x in enumerate(points) if x in true and low_side(true[x]))])
            low, high = points[edge], points[edge + 1]
        return low

    ends = fits([0.0, 1.0])
    if not ends:
        return 1.0
    even = 1.0 if ends[1.0][0] else bisect(0.0, 1.0, lambda t: t[0])
    if not ends[1.0][1]:  # even the corpus as it is repeats more: nothing to temper
        return 1.0
    held = 0.0 if ends[0.0][1] else bisect(0.0, 1.0, lambda t: not t[1])
    return max(even, held)


def plan(rows: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
         budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """One row per source of ``rows`` (source, tokens, _block, _order): its share and weight, whole epochs,
    and where the part of the next epoch ends (key of the last block, order of its last document)."""
    blocks = written(rows.groupBy("source", "_block").agg(F.sum("tokens").alias("tokens")), "blocks")
    totals = written(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "totals")
    a = exponent(totals, target_entropy, max_repeats, budget)
    sums = totals.agg(F.sum("tokens").alias("_all")).crossJoin(F.broadcast(
        totals.crossJoin(totals.agg(F.sum("tokens").alias("_n")))
        .agg(F.sum(F.pow(F.col("tokens") / F.col("_n"), F.lit(a))).alias("_z"))))
    share = F.col("tokens") / F.col("_all")
    weighted = (totals.crossJoin(F.broadcast(sums))
                .withColumn("share", share).withColumn("weight", F.pow(share, F.lit(a)) / F.col("_z"))
                .withColumn("due", F.floor(F.lit(budget) * F.col("_all") * F.col("weight")).cast("long"))
                .select("source", F.lit(a).alias("exponent"), "share", "weight", F.col("tokens").alias("held"), "due",
                        F.expr("due div tokens").alias("epochs"), (F.col("due") % F.col("tokens")).alias("rest")))
    order = [_turn(F.col("source"), F.col("epochs"), F.col("_block"), seed), F.col("_block")]
    placed = (blocks.alias("b").join(if_small(weighted).alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")))
              .select("w.*", "b._block", F.col("b.tokens").alias("tokens")))
    upto = Window.partitionBy("source").orderBy(*order)
    run = placed.withColumn("_upto", F.sum("tokens").over(upto))
    # the first block that does not fit whole: its documents are taken in hash order up to the rest
    last = (run.filter(F.col("_upto") > F.col("rest")).groupBy("source")
            .agg(F.min_by(F.struct("_block", order[0].alias("turn"), (F.col("_upto") - F.col("tokens")).alias("before")),
                          F.struct(*order)).alias("cut")))
    cuts = written(weighted.alias("w").join(last.alias("l"), F.col("w.source").eqNullSafe(F.col("l.source")), "left")
                   .select("w.*", "l.cut"), "cuts")
    partial = (rows.alias("r").join(if_small(cuts).alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
                                    & (F.col("r._block") == F.col("c.cut._block")))
               .select("c.source", "r.tokens", "r._order", (F.col("rest") - F.col("cut.before")).alias("room")))
    ends = (partial.withColumn("_upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("_order")))
            .filter(F.col("_upto") <= F.col("room")).groupBy("source").agg(F.max("_order").alias("upto")))
    return written(cuts.alias("c").join(ends.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source")), "left")
                   .select("c.*", "e.upto"), "plan")


def _copies(seed: int) -> Column:
    turn = _turn(F.col("p.source"), F.col("p.epochs"), F.col("_block"), seed)
    before = F.struct(turn, F.col("_block")) < F.struct(F.col("p.cut.turn"), F.col("p.cut._block"))
    edge = (F.col("_block") == F.col("p.cut._block")) & (F.col("_order") <= F.col("p.upto"))
    return F.col("p.epochs") + F.coalesce((before | F.coalesce(edge, F.lit(False))).cast("int"), F.lit(0))


def drawn(rows: DataFrame, made: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (with source, _block, _order) repeated as the plan says, with ``epoch`` and ``turn``."""
    out = rows.alias("r").join(if_small(made).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    out = out.withColumn("_copies", _copies(seed)).filter("_copies > 0")
    return (out.select("r.*", "p.weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("epoch"))
            .withColumn("turn", _turn(F.col("source"), F.col("epoch"), F.col("_block"), seed)))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: float = BUDGET,
            blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``(id, source, n_tokens, weight, epoch, block, turn)`` for each drawn copy; epochs are read in order,
    the blocks of an epoch by ``turn``."""
    rows = written(docs.select(F.col(id_col), F.col(source_col).alias("source"),
                               token_count(text_col).alias("tokens"),
                               *[c.alias(n) for n, c in _keys(id_col, text_col, blocks, seed).items()]), "tokens")
    made = plan(rows, target_entropy, max_repeats, budget, seed)
    return drawn(rows, made, seed).select(id_col, F.col("source").alias(source_col), F.col("tokens").alias("n_tokens"),
                                          "weight", "epoch", F.col("_block").alias("block"), "turn")


def drawn_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
                    budget: float = BUDGET, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, as often as the mixture draws them, with their own columns."""
    keys = _keys(id_col, text_col, blocks, seed)
    rows = written(docs.select(F.col(source_col).alias("source"), token_count(text_col).alias("tokens"),
                               *[c.alias(n) for n, c in keys.items()]), "tokens")
    made = plan(rows, target_entropy, max_repeats, budget, seed)
    full = docs.select(F.col(source_col).alias("source"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
                       *[c.alias(n) for n, c in keys.items()])
    return drawn(full, made, seed).select("_row.*")

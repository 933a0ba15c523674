"""Language ID by prediction by partial matching (PPM) over bytes.

Learning (bounded by documented parameters): of every language the
``max_examples`` documents that come first in the order of a hash of id and
text (copies once) are read whole. Every text, in lower case, without digits and
led by ``ORDER`` spaces, gives a (context, byte) pair of each order 0 to ``ORDER`` at
every byte; the pairs are counted by Spark. The trees keep the pairs seen at
least t times, with the smallest t at which pairs x languages stay within
``max_cells`` (8 bytes each: what every worker gets). A shorter context of a
kept pair is kept too, as it is seen at least as often.

Frozen statistics: with n the count of a byte after a context and N that of
the context, a kept byte has the probability (2n - 1) / 2N, and escape what
the kept bytes leave of 1. The code length of a byte is found from the longest
context down: an unknown context costs nothing, a known one without the byte
costs its escape, the first with the byte its probability; after the empty
context all 256 bytes are alike. A text's code length in a language is the sum
over all its bytes, exactly: scoring looks up each byte's longest kept pair of
any language, whose lengths in all languages were summed up beforehand.

Prediction: the language of the shortest code (ties: the first by name); score:
its posterior when all languages are alike beforehand, the share of
2^-length; ``bits``: the length.

Defined results: null text and text without any letter give ``und``, score 0
and no bits, as does every text where nothing could be learned. Rows with a null
id are predicted, never learned from. Repeated rows each get a row. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeflow.llm.common import if_small, map_batches, written

ORDER, MAX_EXAMPLES, MAX_CELLS = 4, 300, 2_000_000
STEP = 1 << 20  # bytes scored at once
LEAD = " " * ORDER
UNKNOWN = "und"


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def prepared(text: Column) -> Column:
    return F.concat(F.lit(LEAD), F.translate(F.lower(text), "0123456789", ""))


# -- bytes ------------------------------------------------------------------

def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the offsets of the texts in them."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, step: int = STEP):
    """(text, first byte, last byte + 1, its own first byte) of runs of scored bytes, grouped to about ``step`` bytes;
    the lead-in of a text is only context."""
    group, held = [], 0
    for k in range(len(offsets) - 1):
        a, end = int(offsets[k]) + ORDER, int(offsets[k + 1])
        while a < end:
            b = min(end, a + step - held)
            group.append((k, a, b))
            held += b - a
            a = b
            if held >= step:
                yield group
                group, held = [], 0
    if group:
        yield group


def windows(data: np.ndarray, group: list[tuple[int, int, int]]) -> np.ndarray:
    """For every byte of the group's runs the number made of it and the ORDER bytes before it."""
    out = []
    for _, a, b in group:
        g = np.zeros(b - a, np.int64)
        for back in range(ORDER, -1, -1):
            g <<= 8
            g |= data[a - back:b - back]
        out.append(g)
    return np.concatenate(out)


# -- learning ---------------------------------------------------------------

def examples(docs: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(lang, text): at most ``max_examples`` texts of each language. A first cut by the rate that leaves about four
    times as many lets only those texts move; copies collapse before they do."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(
        F.col(lang_col).alias("lang"), "text", F.xxhash64(F.col(id_col).cast("string"), "text").alias("h"))
    # of different rows, as copies share a hash; the estimate only sets how many more than needed move
    rates = labelled.groupBy("lang").agg((F.lit(4.0 * max_examples) / F.approx_count_distinct("h", 0.02)).alias("rate"))
    share = F.pmod("h", F.lit(1 << 32)) / F.lit(float(1 << 32))
    near = labelled.join(if_small(rates), "lang").filter(share < F.col("rate")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 32)), "h")
    return near.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= max_examples).select("lang", "text")


def _grams(batches):
    for b in batches:
        data, offsets = flat(b["text"])
        langs = b["lang"].to_pylist()
        for group in pieces(offsets):
            g, at = windows(data, group), 0
            for k, a, z in group:
                keys, n = np.unique(g[at:at + z - a], return_counts=True)
                at += z - a
                yield {"lang": pa.array([langs[k]] * len(keys), pa.string()), "gram": keys, "n": n.astype(np.int64)}


def counts(examples: DataFrame) -> DataFrame:
    """(lang, k, gram, n, total): n times the last byte of gram follows the k before it, which occur total times."""
    seen = map_batches(examples.select("lang", prepared(F.col("text")).alias("text")), _grams, "lang string, gram long, n long")
    longest = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram"))
                                 for k in range(ORDER + 1)]))
    every = (longest.select("lang", orders.alias("o"), "n").groupBy("lang", "o.k", "o.gram").agg(F.sum("n").alias("n")))
    context = Window.partitionBy("lang", "k", F.shiftright("gram", 8))  # at most 256 rows
    return every.withColumn("total", F.sum("n").over(context))


class Trees:
    """The kept pairs of all languages. ``grams[k]``: sorted; ``bits[k]``: their code lengths by language;
    ``contexts[k]``, ``escapes[k]``: likewise for contexts."""

    def __init__(self, langs: list[str], rows: dict[str, np.ndarray]):
        self.langs = langs
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            own = rows["k"] == k
            lang, gram, n, total = (rows[c][own] for c in ("lang", "gram", "n", "total"))
            grams, context = np.unique(gram), np.unique(gram >> 8)
            p = (2.0 * n - 1) / (2.0 * total)
            at_context = np.searchsorted(context, gram >> 8)
            left = np.zeros((len(context), len(langs)))
            np.add.at(left, (at_context, lang), 2 * n - 1)
            known = np.zeros(left.shape, np.int64)
            known[at_context, lang] = total
            escape = np.where(known > 0, -np.log2(np.where(known > 0, (2 * known - left) / np.maximum(2 * known, 1), 1)), 0.0)
            bits = escape[np.searchsorted(context, grams >> 8)]
            if k:
                bits = bits + self.bits[-1][np.searchsorted(self.grams[-1], grams & ((1 << 8 * k) - 1))]
            else:
                bits = bits + 8.0
            bits[np.searchsorted(grams, gram), lang] = -np.log2(p)
            self.grams.append(grams)
            self.bits.append(bits)
            self.contexts.append(context)
            self.escapes.append(escape)

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """Code length of every window's last byte after the bytes before it, by language. Windows repeat: each is
        looked up once."""
        g, place = np.unique(g, return_inverse=True)
        out = np.zeros((len(g), len(self.langs)))
        todo = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            if not len(todo):
                break
            at, hit = _find(self.grams[k], g[todo] & ((1 << 8 * (k + 1)) - 1))
            out[todo[hit]] += self.bits[k][at[hit]]
            todo = todo[~hit]
            at, hit = _find(self.contexts[k], (g[todo] >> 8) & ((1 << 8 * k) - 1))
            out[todo[hit]] += self.escapes[k][at[hit]]
        out[todo] += 8.0
        return out[place]

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Code length of every text (prepared: with its lead-in), by language."""
        data, offsets = flat(texts)
        out = np.zeros((len(texts), len(self.langs)))
        for group in pieces(offsets):
            each = self.lengths(windows(data, group))
            starts = np.cumsum([0, *[b - a for _, a, b in group[:-1]]])
            np.add.at(out, [k for k, _, _ in group], np.add.reduceat(each, starts, axis=0))
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def learn(docs: DataFrame, *, max_examples: int = MAX_EXAMPLES, max_cells: int = MAX_CELLS, id_col: str = "doc_id",
          lang_col: str = "lang") -> Trees | None:
    """The trees of all languages in ``docs``; None without any labelled byte."""
    seen = written(counts(examples(docs, max_examples, id_col, lang_col)), "language-counts")
    langs = sorted(r[0] for r in seen.select("lang").distinct().collect())
    if not langs:
        return None
    # rows for each count, from the largest down: the counts of a bounded sample
    per = sorted(((r[0], r[1]) for r in seen.groupBy("n").count().collect()), reverse=True)
    least, held = per[0][0], 0
    for n, rows in per:
        held += rows
        if held * len(langs) > max_cells:
            break
        least = n
    kept = seen.filter(F.col("n") >= least).toPandas()
    where = {x: i for i, x in enumerate(langs)}
    rows = {c: kept[c].to_numpy(np.int64) for c in ("k", "gram", "n", "total")}
    return Trees(langs, rows | {"lang": kept["lang"].map(where).to_numpy(np.int64)})


def predict(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, lang_pred, score, bits) of all documents, through a broadcast of the trees (bounded by max_cells)."""
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    texts = docs.select(F.col(id_col), F.when(readable, prepared(F.col("text"))).otherwise(F.lit("")).alias("text"))
    schema = docs.select(id_col).schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    if trees is None:
        return texts.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(batches):
        trees = shared.value
        names = np.array([*trees.langs, UNKNOWN], dtype=object)
        for b in batches:
            bits = trees.of_texts(b["text"])
            none = np.diff(flat(b["text"])[1]) == 0
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            score = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
            yield {id_col: b[id_col], "lang_pred": names[np.where(none, len(trees.langs), best)],
                   "score": np.where(none, 0.0, score), "bits": pa.array(least, mask=none)}

    return map_batches(texts, scored, schema)


def identified(docs: DataFrame, learn_from: Column, *, id_col: str = "doc_id", **bounds) -> DataFrame:
    """Predictions for every row of ``docs``, learned from its labelled rows that ``learn_from`` holds for."""
    return predict(docs, learn(docs.filter(learn_from), id_col=id_col, **bounds), id_col)

"""Spelling variants by asymmetric q-chunks: words one edit apart, and the form each variant stands for.

Of two words one edit apart take the longer (of equal lengths the smaller) as
the chunk word: it contributes two disjoint chunks that cover it, its first
half and the rest. One edit leaves one of them whole, so it stands in the other
word as a positional gram: the first chunk at its own place, the second moved by
as much as the lengths differ, one at most. The other word therefore
contributes its grams at those places for chunk words of its own length and of
one code point more. Chunks and grams meet in an equality join on a hash of
(length, which half, gram); in the join's condition the pair is verified by
Levenshtein distance, and a pair that both chunks find counts by its first.

Each near pair counts both ways. A word's form is its near word of largest n
(ties: smallest in code-point order) if that n is at least ``ratio`` times its
own. Forms grow in n, so they make trees; roots are found by pointer doubling
over the words that have a form, each round written to the shared folder.

Everything runs in DataFrame functions. The words are counted before any
shuffle (partial aggregates), so a frequent word is one row a task; pairs are made
only of verified words; a crowded chunk is split by Spark's skewed-join handling.

Defined results: null text holds no words; a null id is written as nothing
before the colon. Repeated rows count each time. An empty table, or one without
a word of ``min_count`` occurrences, gives an empty result. Only the id and the
text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeflow.llm.common import utf8, written

NO_WORD = r"[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 6, 5, 5, 199


def noised(run: Column, id_: Column, modulus: int) -> Column:
    """The run without one code point where ``modulus`` divides the checksum of ``<id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
          min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): the distinct words of at least ``min_length`` code points and ``min_count`` occurrences."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.translate(utf8(text_col), UPPER, LOWER), NO_WORD)).alias("run"))
    made = runs.filter(F.length("run") >= min_length).select(noised(F.col("run"), F.col("id"), noise).alias("word"))
    return (made.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_count))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every unordered pair of words exactly one edit apart, once."""
    w = words.select("word", "n", F.length("word").alias("len"))

    def key(length: Column, half: int, gram: Column) -> Column:
        return F.struct(F.lit(half).alias("half"), F.xxhash64(length, F.lit(half), gram).alias("key"))

    def part(start: Column, size: Column) -> Column:  # start from 0
        return F.substring(F.col("word"), (start + 1).cast("int"), size.cast("int"))

    n, zero = F.col("len"), F.lit(0)
    q = F.floor(n / 2)
    chunks = w.select(F.explode(F.array(key(n, 0, part(zero, q)), key(n, 1, part(q, n - q)))).alias("at"),
                      F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("len").alias("len_a")).select("at.*", "a", "n_a", "len_a")

    def grams(more: int) -> list[Column]:  # for chunk words longer by ``more``
        length = n + more
        q = F.floor(length / 2)
        return [key(length, 0, part(zero, q)), key(length, 1, part(q - more, length - q))]

    other = w.select(F.explode(F.array(*grams(0), *grams(1))).alias("at"), F.col("word").alias("b"), F.col("n").alias("n_b"),
                     F.col("len").alias("len_b")).select("at.*", "b", "n_b", "len_b")
    first = F.floor(F.col("len_a") / 2).cast("int")
    near = (((F.col("len_a") > F.col("len_b")) | (F.col("len_a") == F.col("len_b")) & (F.col("a") < F.col("b")))
            & (F.levenshtein("a", "b", 1) == 1)
            & ((F.col("half") == 0) | (F.substring(F.col("a"), F.lit(1), first) != F.substring(F.col("b"), F.lit(1), first))))
    return chunks.join(other, ["half", "key"]).filter(near).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): forms followed to the last."""
    state = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("above"))
        state = written(state.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"),
                                                              F.col("above").isNotNull().alias("moved")), "spelling-roots")
        if not state.filter("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of all words."""
    own = written(words(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count, noise=noise), "words")
    pairs = near_pairs(own)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("near")),
                             F.struct(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("near")))).alias("e")
    best = F.min(F.struct((-F.col("m")).alias("less"), "near"))
    near = pairs.select(ends).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    formed = F.coalesce(form_n >= ratio * F.col("n"), F.lit(False))
    rows = written(own.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"),
        F.when(formed, form_n).alias("form_n")), "spelling-forms")
    return rows.join(roots(rows.filter(F.col("form").isNotNull())), "word", "left").withColumn("root", F.coalesce("root", "word"))

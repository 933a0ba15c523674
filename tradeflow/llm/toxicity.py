"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Fit (bounded by documented parameters): ``max_examples`` labelled documents,
the first in hash order of their ids, are the examples. Terms are the
``max_terms`` words or beginnings of words whose presence among the examples
is most dependent on the label (chi-squared of at least ``MIN_CHI``, or a fifth of the
number of examples if that is less, in at least ``min_examples`` examples, or a tenth of them). Document frequencies for IDF are counted over the whole corpus.

Index: examples are ordered by their heaviest term and cut into blocks of
``block`` rows; each term keeps its largest weight per block. A query adds up
its terms' block maxima to an upper bound per block, opens blocks from the
largest bound down and stops when the next bound is below its k-th best
cosine, so the k nearest are exact (ties to the earlier example).

Score: the cosine-weighted share of toxic labels among the k nearest, mapped
to a probability by a logistic curve fitted to the leave-one-out votes of the
examples. Texts without any term (empty ones too) get the smoothed share of
toxic labels among the examples without any term.

Defined results: null text counts as empty. The id is no input of a score: equal
texts get equal scores, and an example that is scored has itself among its
neighbours. Rows with a null id are scored like any other and are never
examples; of several texts with one labelled id the one of the smallest hash is
the example. Repeated rows each get a score; labels that contradict each
other count as toxic; null labels are ignored. Without any label every score
is 0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeflow.llm.common import map_batches, utf8, written

MAX_EXAMPLES, MAX_TERMS, MIN_EXAMPLES, MIN_CHI = 12_000, 1_500, 4, 20.0
NEIGHBOURS, BLOCK, PREFIXES, FOLDS = 15, 64, (4, 9), 5

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str, sizes=PREFIXES) -> list[str]:
    """The word itself (marked by a closing $) and its beginnings."""
    return [word + "$", *[word[:n] for n in range(sizes[0], min(len(word), sizes[1]) + 1)]]


def count_terms(text: str | None, place: dict[str, int], memo: dict[str, list[int]]) -> Counter:
    """Occurrences of each term (by number) in the lower-cased text; ``memo`` keeps the terms of words seen."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        known = memo.get(word)
        if known is None:
            if len(memo) > 500_000:
                memo.clear()
            known = memo[word] = [place[f] for f in features_of(word) if f in place]
        for t in known:
            out[t] += n
    return out


def fold(id_col: str = "doc_id", folds: int = FOLDS):
    return F.crc32(F.col(id_col).cast("string")) % folds


def chosen_examples(labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id",
                    label_col: str = "toxic") -> DataFrame:
    """``(id, label)`` of at most ``max_examples`` labelled rows outside fold 0."""
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 0))
    one = own.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(max_examples)


def informative_terms(examples: DataFrame, max_terms: int = MAX_TERMS, min_examples: int = MIN_EXAMPLES) -> list[str]:
    """Terms most dependent on the label among ``examples`` (text, label)."""
    def counts(batches):
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(b["text"].to_pylist(), b["label"].to_pylist()):
                words = set(_WORD.findall((t or "").lower()))
                seen[int(y > 0)].update({f for w in words for f in features_of(w)})
            both = list(seen[0].keys() | seen[1].keys())
            yield {"term": both, "neg": [seen[0][t] for t in both], "pos": [seen[1][t] for t in both]}

    n = {r.label: r["count"] for r in examples.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    neg, pos = n.get(0, 0), n.get(1, 0)
    if not neg or not pos:
        return []
    a, b, all_ = F.col("pos"), F.col("neg"), float(neg + pos)
    # chi-squared cannot exceed the number of examples: of few examples less is asked
    least, min_examples = min(MIN_CHI, all_ / 5), max(1, min(min_examples, (neg + pos) // 10))
    chi = (all_ * F.pow(a * (neg - b) - b * (pos - a), 2.0) / ((a + b) * (all_ - a - b) * neg * pos))
    per = (map_batches(examples, counts, "term string, neg long, pos long").groupBy("term")
           .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
           .filter((a + b >= min_examples) & (a + b < all_)).select("term", chi.alias("chi")))
    return sorted(r.term for r in per.filter(F.col("chi") >= least).orderBy(F.desc("chi"), "term").limit(max_terms).collect())


def term_vectors(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, terms, counts)`` for every row."""
    place = {t: i for i, t in enumerate(terms)}

    def vectors(batches):
        memo: dict[str, list[int]] = {}
        for b in batches:
            found = [sorted(count_terms(t, place, memo).items()) for t in b["text"].to_pylist()]
            yield {"id": b["id"], "terms": [[i for i, _ in f] for f in found],
                   "counts": [[n for _, n in f] for f in found]}

    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")), vectors,
                       "id long, terms array<int>, counts array<int>")


def _presence(batches):
    """Documents that hold each term, one row per term and task."""
    held: Counter = Counter()
    for b in batches:
        held.update(pc.list_flatten(b["terms"]).to_pylist())
    yield {"term": list(held), "n": list(held.values())}


class BlockMaxIndex:
    """Exact top-k cosine over sparse example vectors, with block maxima."""

    def __init__(self, vectors: list[tuple[list[int], list[float]]], labels: list[int], n_terms: int,
                 block: int = BLOCK):
        import numpy as np
        order = sorted(range(len(vectors)), key=lambda i: (
            vectors[i][0][int(np.argmax(vectors[i][1]))] if vectors[i][0] else -1, i))
        self.block, self.order = block, np.array(order, dtype=np.int64)
        self.labels = np.array([labels[i] for i in order], dtype=np.float64)
        n_blocks = -(-len(order) // block)
        self.maxima = np.zeros((n_terms, n_blocks))
        self.blocks: list[tuple] = []  # of each block: row, term and weight of every posting
        for k in range(n_blocks):
            own = [vectors[i] for i in order[k * block:(k + 1) * block]]
            row = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
            term = np.array([x for t, _ in own for x in t], dtype=np.int64)
            weight = np.array([x for _, w in own for x in w])
            self.blocks.append((row, term, weight, len(own)))
            np.maximum.at(self.maxima[:, k], term, weight)

    def nearest(self, terms: list[int], weights: list[float], k: int, without: int = -1):
        """(rows, cosines) of the k nearest, best first; ``without``: a row that takes no part."""
        import numpy as np
        query = np.zeros(len(self.maxima))
        query[terms] = weights
        bound = np.asarray(weights) @ self.maxima[terms]
        best = np.empty(0)
        rows = np.empty(0, dtype=np.int64)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1] - 1e-12):
                break
            row, term, weight, size = self.blocks[b]
            score = np.bincount(row, query[term] * weight, size)
            least = best[-1] - 1e-12 if len(best) == k else 1e-15
            own = np.flatnonzero(score >= least) + b * self.block
            own = own[own != without]
            if not len(own):
                continue
            best = np.concatenate((best, np.round(score[own - b * self.block], 12)))
            rows = np.concatenate((rows, own))
            keep = np.lexsort((self.order[rows], -best))[:k]
            best, rows = best[keep], rows[keep]
        return rows, best

    def vote(self, terms: list[int], weights: list[float], k: int, without: int = -1) -> float:
        rows, cos = self.nearest(terms, weights, k, without)
        return float((cos * self.labels[rows]).sum() / cos.sum()) if len(rows) else math.nan


def weigh(terms: list[int], counts: list[int], idf) -> tuple[list[int], list[float]]:
    """Unit-length weights (1 + ln tf) * idf; terms without weight go."""
    w = [(1.0 + math.log(c)) * idf[t] for t, c in zip(terms, counts)]
    norm = math.sqrt(sum(x * x for x in w))
    return (list(terms), [x / norm for x in w]) if norm > 0 else ([], [])


def logistic_curve(votes, labels, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    import numpy as np
    x, y = np.c_[np.asarray(votes), np.ones(len(votes))], np.asarray(labels, dtype=float)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (y - p) - 0.05 * beta)
        beta = beta + np.clip(step, -5, 5)
    return float(beta[0]), float(beta[1])


class Model:
    """Terms, index and calibration; plain Python and numpy, sent to the tasks."""

    def __init__(self, terms: list[str], idf: list[float], rows: list[tuple], neighbours: int = NEIGHBOURS):
        """``rows``: (id, label, term numbers, counts) of the examples."""
        self.place, self.idf, self.neighbours = {t: i for i, t in enumerate(terms)}, idf, neighbours
        weighed = [(i, y, *weigh(t, c, idf)) for i, y, t, c in rows]
        own = [x for x in weighed if x[2]]
        blank = [x[1] for x in weighed if not x[2]]
        self.prior = (sum(blank) + 0.5) / (len(blank) + 1) if blank else 0.0
        self.ids = [x[0] for x in own]
        self.index = BlockMaxIndex([(x[2], x[3]) for x in own], [x[1] for x in own], max(1, len(terms)))
        row_of = {int(i): r for r, i in enumerate(self.index.order)}
        # calibration only: an example does not vote for itself
        votes = [self.index.vote(x[2], x[3], neighbours, row_of[n]) for n, x in enumerate(own)]
        known = [(v, x[1]) for v, x in zip(votes, own) if not math.isnan(v)]
        self.slope, self.offset = logistic_curve(*zip(*known)) if known else (0.0, 0.0)

    def score(self, terms, counts, memo: dict) -> tuple[float, list]:
        """(score, ids of the nearest examples): the text alone decides, whatever its row's id."""
        key = (tuple(terms), tuple(counts))
        if key not in memo:
            if len(memo) > 50_000:
                memo.clear()
            own = weigh(terms, counts, self.idf)
            found, cos = self.index.nearest(*own, self.neighbours) if own[0] else ([], [])
            value, near = self.prior, []
            if len(found):
                vote = float((cos * self.index.labels[found]).sum() / cos.sum())
                value = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * vote + self.offset))))
                near = [self.ids[self.index.order[r]] for r in found]
            memo[key] = (value, near)
        return memo[key]

    def score_column(self, text_col):
        """The score of a text where it stands: no row is moved."""
        from collections.abc import Iterator

        import pandas as pd

        def of(batches):
            words, memo = {}, {}
            for texts in batches:
                out = []
                for t in texts:
                    found = sorted(count_terms(t, self.place, words).items())
                    out.append(self.score([k for k, _ in found], [n for _, n in found], memo)[0])
                yield pd.Series(out, dtype="float64")

        of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(of, "double")(text_col)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS,
        neighbours: int = NEIGHBOURS) -> tuple[Model, DataFrame]:
    """The model, and ``(id, terms, counts)`` of every row of ``docs``."""
    spark = docs.sparkSession
    chosen = written(chosen_examples(labels, max_examples, id_col, label_col), "examples")
    picked = F.broadcast(chosen.select(F.col(id_col).alias("id"), "label"))  # at most max_examples rows
    own = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    # rows of one id may hold unlike texts: the one of the smallest hash is the example
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    texts = written(own.join(picked, "id").groupBy("id", "label").agg(least), "example-texts")
    terms = informative_terms(texts.repartition(spark.sparkContext.defaultParallelism, "id"), max_terms)
    vectors = written(term_vectors(docs, terms, id_col, text_col), "term-vectors")
    n_docs = vectors.count()
    df = {r.term: r.n for r in map_batches(vectors.select("terms"), _presence, "term int, n long")
          .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = [math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for t in range(len(terms))]
    labelled = texts.select("id", "label").join(term_vectors(texts, terms, "id"), "id")
    rows = sorted((r.id, r.label, r.terms, r.counts) for r in labelled.collect())  # at most max_examples rows
    return Model(terms, idf, rows, neighbours), vectors


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", **options) -> DataFrame:
    """``(id, score, evidence)`` per row of ``docs``; evidence holds the ids of the nearest examples."""
    model, vectors = fit(docs, labels, id_col, text_col, label_col, **options)

    def score(batches):
        memo: dict = {}
        for b in batches:
            out = [model.score(*x, memo) for x in zip(b["terms"].to_pylist(), b["counts"].to_pylist())]
            yield {"id": b["id"], "score": [x[0] for x in out], "evidence": [x[1] for x in out]}

    return map_batches(vectors, score, "id long, score double, evidence array<long>").withColumnRenamed("id", id_col)

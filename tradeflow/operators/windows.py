"""Which windows of texts may be needles: the keys of ``link.contains_join``.

A needle's key is a hash of all its bytes, so a text meets the needles it
contains and, but for equal hashes, no others, however many needles share
their parts. A text's windows of all the needles' lengths would be many, so
they are sieved by one set of bits in two steps: a window of a class's length
(the largest of ``CLASSES`` that a needle has; a shorter needle is a class of its own
length) stays where it may begin a needle of that class, and there the windows
of the lengths in that class stay that may be a whole needle. The bits lose none.

Literal containment of valid UTF-8 is that of its bytes. Hashes are polynomials
over the bytes, modulo 2^64, so that those of 2n bytes come from those of n for
all places of a stretch of texts at once; a stretch is of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

CLASSES = (8, 16, 32)  # bytes
STRETCH = 1 << 17  # bytes of texts that are hashed at once
NEEDLE_BITS = 1 << 28  # of the set at most: 32 MB for each worker
BITS = 32  # a needle, below that
LEAD, WHOLE = (36, 18), (36, 20, 0)  # shifts of a hash: its places among the bits
_BASE, _ODD, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of windows of ``data`` (bytes): of a power of two for all places, of other lengths for some."""

    def __init__(self, data: np.ndarray):
        self.by = {1: mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))[data]}

    def all(self, length: int) -> np.ndarray:
        if length not in self.by:
            h, half = self.all(length // 2), length // 2
            self.by[length] = h[:-half] * np.uint64(pow(_BASE, half, _WORD + 1)) + h[half:] if len(h) > half else h[:0]
        return self.by[length]

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        out, done = np.zeros(len(starts), np.uint64), 0
        while done < length:
            step = min(CLASSES[-1], 1 << ((length - done).bit_length() - 1))
            out = out * np.uint64(pow(_BASE, step, _WORD + 1)) + self.all(step)[starts + done]
            done += step
        return out


def lead(hashes: np.ndarray, k: int) -> np.ndarray:
    """What the window that begins a needle of class ``k`` is looked up by."""
    return (hashes + np.uint64(k * 0x632BE59BD9B4E019 & _WORD)) * np.uint64(_ODD)


def whole(hashes: np.ndarray, length: int) -> np.ndarray:
    return mixed(hashes + np.uint64(length * _ODD & _WORD))


def class_of(length: int) -> int:
    return max((k for k in CLASSES if k <= length), default=length)


def laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts end to end, and where each begins and the last ends; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def stretches(at: np.ndarray, more: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, c): windows that start from ``a`` to ``b`` lie before ``c``, if they have ``more`` bytes at most."""
    for a in range(int(at[0]), int(at[-1]), size):
        b = min(a + size, int(at[-1]))
        yield a, b, min(b + more - 1, int(at[-1]))


def needle_keys(needles: DataFrame, c: str) -> DataFrame:
    """``needles`` with their length in bytes, class, key and the hash of their beginning."""
    def run(batches):
        for batch in batches:
            data, at = laid(batch.column(c))
            length = np.diff(at)
            out = {"_length": length.astype(np.int32), "_class": np.zeros(len(length), np.int32),
                   "_key": np.zeros(len(length), np.uint64), "_lead": np.zeros(len(length), np.uint64)}
            rows = 0
            while rows < len(length):  # some rows at a time
                to = max(rows + 1, int(np.searchsorted(at, at[rows] + STRETCH, "right")) - 1)
                h = Hashes(data[at[rows]:at[to]])
                for n in np.unique(length[rows:to]).tolist():
                    own = rows + np.flatnonzero(length[rows:to] == n)
                    if n:
                        starts = at[own] - at[rows]
                        out["_class"][own] = class_of(n)
                        out["_key"][own] = whole(h.at(starts, n), n)
                        out["_lead"][own] = lead(h.at(starts, class_of(n)), class_of(n))
                rows = to
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in out.values()]],
                                             names=[*batch.schema.names, *out])

    more = [T.StructField("_length", T.IntegerType()), T.StructField("_class", T.IntegerType()),
            T.StructField("_key", T.LongType()), T.StructField("_lead", T.LongType())]
    return needles.mapInArrow(run, T.StructType(needles.schema.fields + more))


def sieve(keys: DataFrame, n: int) -> np.ndarray:
    """The bits of ``n`` needles' keys and beginnings, as words; folded before they come to the driver."""
    bits = 1 << 16
    while bits < min(BITS * n, NEEDLE_BITS):
        bits *= 2
    places = [F.shiftrightunsigned(c, s).bitwiseAND(F.lit(bits - 1)) for c, shifts in (("_lead", LEAD), ("_key", WHOLE)) for s in shifts]
    at = keys.select(F.explode(F.array(*places)).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_bits"))
    found, out = words.toArrow(), np.zeros(bits // 64, np.uint64)
    out[found["_word"].to_numpy()] = found["_bits"].to_numpy().view(np.uint64)
    return out


def passing(h: np.ndarray, words: np.ndarray, shifts: Sequence[int]) -> np.ndarray:
    """The places of ``h`` whose bits are all set."""
    mask, left = np.uint64(len(words) * 64 - 1), None
    for s in shifts:
        at = ((h if left is None else h[left]) >> np.uint64(s)) & mask
        hit = np.flatnonzero((words[(at >> np.uint64(6)).astype(np.intp)] >> (at & np.uint64(63))) & np.uint64(1))
        left = hit if left is None else left[hit]
    return left


def text_keys(texts: DataFrame, c: str, words: np.ndarray, lengths: dict[int, list[int]], size: int = STRETCH) -> DataFrame:
    """``texts``, each row beside the (_class, _key) of its windows that may be needles; ``lengths``: those in each class."""
    bits, longest = texts.sparkSession.sparkContext.broadcast(words), max(max(x) for x in lengths.values())

    def found(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        for a, b, c in stretches(at, longest, size):
            h = Hashes(data[a:c])
            for k, own in lengths.items():
                first = h.all(k) if k in CLASSES else h.at(np.arange(max(0, c - a - k + 1)), k)
                starts = passing(lead(first[:b - a], k), bits.value, LEAD)
                row = np.searchsorted(at, starts + a, "right") - 1
                room = at[row + 1] - a - starts
                for n in own:
                    fits = room >= n
                    key = whole(h.at(starts[fits], n), n)
                    hit = passing(key, bits.value, WHOLE)
                    yield row[fits][hit], k, key[hit]

    def run(batches):
        for batch in batches:
            parts = list(found(*laid(batch.column(c))))
            if parts:
                rows = pa.array(np.concatenate([r for r, _, _ in parts]))
                kinds = np.concatenate([np.full(len(r), k, np.int32) for r, k, _ in parts])
                keys = np.concatenate([x for _, _, x in parts]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[x.take(rows) for x in batch.columns], pa.array(kinds), pa.array(keys)],
                                                 names=[*batch.schema.names, "_class", "_key"])

    more = [T.StructField("_class", T.IntegerType()), T.StructField("_key", T.LongType())]
    return texts.mapInArrow(run, T.StructType(texts.schema.fields + more))


def keys_of(needles: DataFrame, n: int, c: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds (_class, _key) to texts, for the ``n`` needles of which :func:`needle_keys` were written."""
    lengths: dict[int, list[int]] = {}
    for k, length in sorted(needles.select("_class", "_length").distinct().collect()):  # as many as there are lengths
        lengths.setdefault(k, []).append(length)
    if not lengths:
        return lambda texts: texts.withColumns({"_class": F.lit(0), "_key": F.lit(0).cast("long")}).limit(0)
    words = sieve(needles, n)
    return lambda texts: text_keys(texts, c, words, lengths)

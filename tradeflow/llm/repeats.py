"""Exact removal of repeated byte strings by longest-previous-factor arrays.

Every text is a string of UTF-8 bytes; a window is a substring of ``length``
bytes. A window is repeated if an equal one starts anywhere else.

Buckets: the anchor of a window is the leftmost of its ``gram``-byte substrings
with the least hash. Equal windows have equal anchors at the same place, so a
suffix array of the corpus falls apart into independent ones, one for each
anchor hash. Neighbouring windows with one anchor form a run: its bytes, cut
out of the document, hold them all.

1. Documents emit their runs (anchor hash, hash of the run's bytes, place).
2. Anchors that occur once are done: nothing in them is repeated. Where all
   runs of an anchor are equal, all their windows are repeated.
3. Otherwise each distinct run is fetched once and the runs of an anchor are
   laid side by side in corpus order. Prefix doubling puts their suffixes in order
   to the depth ``length``. In that order the previous and the next smaller
   position of each window are found; the longer of the prefixes shared
   with them is its longest previous factor. A window whose factor is
   ``length`` is a copy of an earlier one; without ``keep_first`` the earlier
   one, its source, goes too.
4. An anchor with more than ``crowd`` distinct runs (a passage in very many
   contexts) is not laid side by side in one task: its windows are counted by
   their 128-bit hash in a shuffled aggregate instead, with the same outcome.

Removed bytes are the union of the repeated windows (``keep_first``: of those
with an earlier equal window, in order of id, then position), judged on the
input.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing. Rows with equal ids and texts are copies of each other; under
``keep_first`` all of them keep their first copy's bytes. Null ids come first
in the order. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeflow.llm.common import map_batches, utf8, written

LENGTH, GRAM, CHUNK, BUCKET_BYTES, CROWD = 400, 64, 1 << 20, 1 << 20, 20_000
SLICE = 256  # documents that a task holds as Python objects at once
FIRST_DEPTH = 5  # bytes that are sorted as they are, before prefix doubling
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2 ** 64."""
    import numpy as np
    up, down = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    up[0] = down[0] = 1
    inverse = pow(_BASE, -1, 1 << 64)
    done = 1
    while done < n:
        take = min(done, n - done)
        up[done:done + take] = up[:take] * np.uint64(pow(_BASE, done, 1 << 64))
        down[done:done + take] = down[:take] * np.uint64(pow(inverse, done, 1 << 64))
        done += take
    return up, down


def _mixed(x):
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Finds the runs of windows with one anchor in a buffer of documents."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK):
        import numpy as np
        self.length, self.gram, self.chunk = length, min(gram, length), chunk
        self.width = length - self.gram + 1  # grams in a window
        self.up, self.down = _powers(chunk + 1)
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

    def runs(self, data: bytes, ends):
        """(anchor hash, first window, windows) arrays; ``ends`` are the documents' ends within ``data``."""
        import numpy as np
        n, w, g = len(data), self.width, self.gram
        none = np.empty(0, dtype=np.int64)
        if n < self.length:
            return np.empty(0, dtype=np.uint64), none, none
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.letters[np.frombuffer(data, dtype=np.uint8)] * self.up[:n], out=total[1:])
        hashes = _mixed((total[g:] - total[:-g]) * self.down[:n - g + 1])
        place = np.uint64(self.chunk - 1)
        keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        windows = len(keys) - w + 1
        padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:len(keys)] = keys
        table = padded.reshape(-1, w)
        before = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(after[:windows], before[w - 1:w - 1 + windows]) & place).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        sound = np.zeros(windows + 1, dtype=np.int32)  # windows that stay within one document
        own = (ends - starts >= self.length)
        np.add.at(sound, starts[own], 1)
        np.add.at(sound, ends[own] - self.length + 1, -1)
        at = np.flatnonzero(np.cumsum(sound[:windows]) > 0)
        if not len(at):
            return np.empty(0, dtype=np.uint64), none, none
        a = anchor[at]
        # the same anchor means the same document, as a window holds its anchor
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1))))
        return hashes[a[first]], at[first], np.diff(np.concatenate((first, [len(at)])))

    def of_documents(self, texts: list[bytes]):
        """Yields (document, anchor hash, start, windows, bytes hash) for each run."""
        import numpy as np
        from xxhash import xxh3_64_intdigest
        parts: list[tuple[int, int, bytes]] = []  # document, offset, piece

        def flush():
            data = b"".join(p[2] for p in parts)
            ends = np.cumsum([len(p[2]) for p in parts])
            hashes, start, count = self.runs(data, ends)
            which = np.searchsorted(ends, start, side="right")
            view = memoryview(data)
            begin = ends - np.array([len(p[2]) for p in parts])
            for h, s, c, k in zip(hashes.tolist(), start.tolist(), count.tolist(), which.tolist()):
                doc, offset, _ = parts[k]
                yield doc, h, offset + s - int(begin[k]), c, xxh3_64_intdigest(view[s:s + c - 1 + self.length])

        size = 0
        for i, t in enumerate(texts):
            if len(t) < self.length:
                continue
            for at in range(0, max(1, len(t) - self.length + 1), self.chunk - self.length + 1):
                piece = t[at:at + self.chunk]
                if size + len(piece) > self.chunk:
                    yield from flush()
                    parts, size = [], 0
                parts.append((i, at, piece))
                size += len(piece)
        if parts:
            yield from flush()


def _slices(batches, rows: int = SLICE):
    """The batches in pieces of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, len(next(iter(b.values()))), rows):
            yield {name: column.slice(at, rows) for name, column in b.items()}


def _signed(x: int) -> int:
    return (x ^ (1 << 63)) - (1 << 63)


def suffix_levels(data, length: int):
    """(order, [(depth, class)]) of all positions by their first ``length`` bytes, by prefix doubling: at each depth equal
    prefixes have equal classes; in the order, prefixes equal to the last depth stand by position."""
    import numpy as np
    n = len(data)
    bits = max(1, n.bit_length())
    depth = min(FIRST_DEPTH, length)
    padded = np.concatenate((data, np.zeros(depth, dtype=np.uint8))).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(depth):
        key = (key << np.uint64(8)) | padded[j:j + n]
    order, rank = _ranked(key, 8 * depth, bits)
    levels = [(depth, rank.astype(np.int32))]
    while depth < length:
        step = min(depth, length - depth)
        ahead = np.zeros(n, dtype=np.uint64)
        ahead[:max(0, n - step)] = rank[step:] + np.uint64(1)
        order, rank = _ranked((rank << np.uint64(bits)) | ahead, 2 * bits, bits)
        depth += step
        levels.append((depth, rank.astype(np.int32)))
    return order, levels


def suffix_classes(data, length: int):
    """(order, class) at the last depth."""
    order, levels = suffix_levels(data, length)
    return order, levels[-1][1]


def smaller_before(values):
    """For each place the last place before it with a smaller value, -1 if none: pointers that jump along those found so
    far, all places at once; what is jumped over is never smaller."""
    import numpy as np
    at = np.arange(len(values)) - 1
    open_ = np.arange(1, len(values))
    while len(open_):
        open_ = open_[values[at[open_]] > values[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def common_prefix(data, levels, i, j, length: int):
    """Length of the common prefix of the suffixes at ``i`` and ``j`` (arrays), at most ``length``: from the deepest classes
    down, then byte by byte below the first depth."""
    import numpy as np
    done, n = np.zeros(len(i), dtype=np.int64), len(data)
    for depth, rank in reversed(levels):
        a, b = i + done, j + done
        fits = (done + depth <= length) & (np.maximum(a, b) + depth <= n)
        done += depth * (fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]))
    more = done < length
    for _ in range(levels[0][0]):
        a, b = i + done, j + done
        more &= (done < length) & (np.maximum(a, b) < n)
        more &= data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)]
        done += more
    return done


def previous_factors(data, own, levels, length: int):
    """(factor, source): for each position of ``own`` (positions in suffix order) the longest prefix, up to ``length``
    bytes, that also starts at an earlier position of ``own``, and the place in ``own`` of one such (-1: no earlier
    position). The longest is shared with the previous or the next smaller position in suffix order."""
    import numpy as np
    before = smaller_before(own)
    after = len(own) - 1 - smaller_before(own[::-1])[::-1]
    after[after == len(own)] = -1
    factor, source = np.zeros(len(own), dtype=np.int64), np.full(len(own), -1)
    for other in (before, after):
        there = np.flatnonzero(other >= 0)
        shared = common_prefix(data, levels, own[there], own[other[there]], length)
        longer = (shared > factor[there]) | (source[there] < 0)
        factor[there[longer]], source[there[longer]] = shared[longer], other[there[longer]]
    return factor, source


def _ranked(key, key_bits: int, bits: int):
    """(order, rank) of ``key``; ties by position. Key and position are sorted as one number where they fit."""
    import numpy as np
    if key_bits + bits <= 64:
        both = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
        order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        sorted_ = both >> np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
    rank = np.empty(len(key), dtype=np.uint64)
    rank[order] = np.cumsum(np.concatenate(([False], sorted_[1:] != sorted_[:-1])))
    return order, rank


def repeated_windows(strings: list[bytes], counts: list[int], length: int, keep_first: bool):
    """For each run (in corpus order) a mask of its windows that go."""
    import numpy as np
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(s) for s in strings])))[:-1]
    valid = np.zeros(len(data), dtype=bool)
    for b, c in zip(begin, counts):
        valid[b:b + c] = True
    order, levels = suffix_levels(data, length)
    own = order[valid[order]]  # suffix order of the windows
    factor, source = previous_factors(data, own, levels, length)
    later = np.flatnonzero(factor >= length)  # copies of an earlier window
    gone = np.zeros(len(data), dtype=bool)
    gone[own[later]] = True
    if not keep_first:
        gone[own[source[later]]] = True
    return [gone[b:b + c] for b, c in zip(begin, counts)]


def _spans(mask, start: int, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by the windows of a mask that begins at ``start``."""
    import numpy as np
    at = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(at[::2], at[1::2])]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, keep_first: bool = False, crowd: int = CROWD,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(k1, k2, start, end)``: spans to remove from the text whose id is k1 (null: the least) and hash k2."""
    keyed = _keyed(docs, id_col, text_col)

    def runs(batches):
        import numpy as np
        finder = Anchors(length, gram)
        for b in _slices(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
            rows = list(finder.of_documents(texts))
            doc = np.array([r[0] for r in rows], dtype=np.int64)
            yield {"k1": b["k1"].take(doc), "k2": b["k2"].take(doc), "anchor": [_signed(r[1]) for r in rows],
                   "start": [r[2] for r in rows], "n": [r[3] for r in rows], "whole": [_signed(r[4]) for r in rows]}

    found = written(map_batches(keyed.filter(F.octet_length("text") >= length), runs,
                                "k1 long, k2 long, anchor long, start long, n long, whole long"), "runs")
    many = (found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("whole").alias("a"), F.max("whole").alias("b"))
            .filter("c > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")))
    many = written(many, "anchors")  # as a table of its own, the join can split a hot anchor
    shared = written(found.join(many, "anchor"), "shared")
    # one run of each (anchor, bytes), the first in corpus order, stands for all
    first = F.min(F.struct("k1", "k2", "start", "n")).alias("r")
    kinds = shared.groupBy("anchor", "whole", "mixed").agg(F.count(F.lit(1)).alias("copies"), first)
    kinds = written(kinds.select("anchor", "whole", "mixed", "copies", "r.*"), "kinds")
    span = [F.col("start"), (F.col("start") + F.col("n") - 1 + length).alias("end")]
    copied = shared.join(kinds.filter("copies > 1").select("anchor", "whole", *[F.col(c).alias(f"_{c}") for c in
                                                                                ("k1", "k2", "start")]), ["anchor", "whole"])
    if keep_first:
        copied = copied.filter(~((F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
                                 & (F.col("start") == F.col("_start"))))
    copied = copied.select("k1", "k2", *span)

    crowds = written(kinds.filter("mixed").groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"),
                     "crowds")
    fetched = written(_fetch(keyed, kinds.filter("mixed"), length), "variants")
    calm = fetched.join(crowds, "anchor", "left_anti")
    order = ["anchor", "k1", "k2", "start"]
    side = calm.repartition("anchor").sortWithinPartitions(*order)

    def factors(batches):
        held: dict[str, list] = {c: [] for c in ("anchor", "k1", "k2", "start", "n", "copies", "bytes")}
        size = 0

        def flush(upto):
            out: dict[str, list] = {"k1": [], "k2": [], "start": [], "end": []}
            masks = repeated_windows(held["bytes"][:upto], held["n"][:upto], length, keep_first)
            for k, mask in enumerate(masks):
                if keep_first or held["copies"][k] == 1:  # the others go as a whole
                    for s, e in _spans(mask, held["start"][k], length):
                        for c, v in zip(out, (held["k1"][k], held["k2"][k], s, e)):
                            out[c].append(v)
            for c in held:
                del held[c][:upto]
            return out

        for b in batches:
            columns = {c: b[c].to_pylist() for c in held}
            for k in range(len(columns["anchor"])):
                if size >= bucket_bytes and columns["anchor"][k] != held["anchor"][-1]:
                    yield flush(len(held["anchor"]))
                    size = 0
                for c in held:
                    held[c].append(columns[c][k])
                size += len(columns["bytes"][k])
        if held["anchor"]:
            yield flush(len(held["anchor"]))

    spans = "k1 long, k2 long, start long, end long"
    factored = map_batches(side, factors, spans)

    def windows(batches):
        from xxhash import xxh3_128_digest
        for b in batches:
            rows = [(k1, k2, s + j, xxh3_128_digest(v[j:j + length]), c) for k1, k2, s, n, c, v in zip(
                *(b[c].to_pylist() for c in ("k1", "k2", "start", "n", "copies", "bytes"))) for j in range(n)]
            yield {c: [r[k] for r in rows] for k, c in enumerate(("k1", "k2", "start", "h", "copies"))}

    each = map_batches(fetched.join(crowds, "anchor", "left_semi"), windows,
                       "k1 long, k2 long, start long, h binary, copies long")
    place = F.struct("k1", "k2", "start")
    twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first")).filter("c > 1")
    counted = each.join(twice, "h").filter((place != F.col("first")) if keep_first else (F.col("copies") == 1))
    counted = counted.select("k1", "k2", "start", (F.col("start") + length).alias("end"))
    return copied.unionByName(factored).unionByName(counted)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = utf8(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"),
                       F.xxhash64(text).alias("k2"), text.alias("text"))


def _fetch(keyed: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """The bytes of one run of each kind."""
    def cut(batches):
        for b in _slices(batches):
            out: dict[str, list] = {c: [] for c in ("anchor", "k1", "k2", "start", "n", "copies", "bytes")}
            for k1, k2, t, wanted in zip(*(b[c].to_pylist() for c in ("k1", "k2", "text", "wanted"))):
                data = t.encode("utf-8", "surrogatepass")
                for w in wanted:
                    row = (w["anchor"], k1, k2, w["start"], w["n"], w["copies"],
                           data[w["start"]:w["start"] + w["n"] - 1 + length])
                    for c, v in zip(out, row):
                        out[c].append(v)
            yield out

    per = kinds.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "start", "n", "copies")).alias("wanted"))
    joined = keyed.join(per, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return map_batches(joined, cut, "anchor long, k1 long, k2 long, start long, n long, copies long, bytes binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    gram: int = GRAM, keep_first: bool = False, crowd: int = CROWD,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept, removed)`` per row: the bytes that stay and the removed spans."""
    spans = repeated_spans(docs, id_col, text_col, length, gram, keep_first, crowd, bucket_bytes)
    per = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    own = _keyed(docs, id_col, text_col).join(per, ["k1", "k2"], "left")

    def cut(batches):
        for b in _slices(batches):
            out: dict[str, list] = {c: [] for c in ("k1", "n_bytes", "n_removed", "n_spans", "kept", "removed")}
            for k1, t, spans in zip(*(b[c].to_pylist() for c in ("k1", "text", "spans"))):
                data = t.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                row = (None if k1 == -(1 << 63) else k1, len(data), len(data) - len(kept), len(merged), kept,
                       [{"start": s, "end": e} for s, e in merged])
                for c, v in zip(out, row):
                    out[c].append(v)
            yield {"id": out.pop("k1")} | out

    return map_batches(own.select("k1", "text", "spans"), cut, "id long, n_bytes long, n_removed long, n_spans long, "
                       "kept binary, removed array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)

"""SimHash near-duplicates by multi-index hashing.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes (seed
42) of a text's word shingles. Two fingerprints link at ``max_bits`` or fewer
differing bits; linked documents form components.

Search: the 64 bits are cut into segments. By the pigeonhole principle with
radii r_i whose sum is ``max_bits - segments + 1``, two linked fingerprints
agree within r_i in at least one segment i. Each distinct fingerprint probes
the table of segment i with the Hamming ball of radius r_i around its own
segment value; matches are verified on all 64 bits. Copies share one
fingerprint and are one entry of the tables.

Crowded table entries (more than ``crowd`` distinct fingerprints under one
segment value, as in large groups of near copies) would make a number of
pairs that grows with the square of the group. Every fingerprint that probes
such an entry is linked through whole-word midpoints instead: two words differ
in at most 2k bits exactly if some word lies within k bits of both, so each
emits its ball of radius k once and links to the smallest fingerprint that
meets it. A midpoint has at most as many members as its own ball, so no group
is unbounded, and no link is lost.

Defined results: a null text is an empty one; a text without words has
fingerprint zero and links like any other; with fewer words than a shingle the
whole sequence is the one shingle. Repeated rows stay, with one component.
Null ids stay; they name a component only if it has no other id (then null).
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeflow.operators.graph import connected_components
from tradeflow.session import cut_lineage

SHINGLE_WORDS, MAX_BITS, SEGMENTS, CROWD, SEED = 3, 2, 2, 4, 42


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest
    # bytes.lower() and bytes.split() know ASCII only: A-Z and [\\x20\\x09-\\x0D]
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate(([0], ends[:-1]))[:len(parts) - words + 1].tolist()
        hashes = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1:] - 1).tolist())]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    out = 0
    for lane in range(8):
        ones = np.bincount(lanes[:, lane], minlength=256) @ bits
        for b in np.flatnonzero(2 * ones > len(hashes)).tolist():
            out |= 1 << (8 * lane + b)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, fp)``: fp is the fingerprint as a signed 64-bit integer."""
    def of(batches):
        import pandas as pd
        for texts in batches:
            yield pd.Series([(f ^ (1 << 63)) - (1 << 63) for f in (fingerprint(t, words) for t in texts)],
                            dtype="int64")

    from collections.abc import Iterator

    import pandas as pd
    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(F.col(id_col), F.pandas_udf(of, T.LongType())(F.col(text_col)).alias("fp"))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return (x ^ (1 << 63)) - (1 << 63)


def hamming_links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) whose connected components
    are those of all pairs within ``max_bits`` (an even number)."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: midpoints need one radius for both sides")
    width = 64 // segments
    spare = max(max_bits - segments + 1, 0)
    radii = [spare // segments + (i < spare % segments) for i in range(segments)]
    seg = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(_signed((1 << width) - 1 if width < 64 else -1)))
           for i in range(segments)]
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    key = lambda i, v: F.struct(F.lit(i).alias("seg"), v.alias("val"))
    table = fps.select(F.explode(F.array(*[key(i, s) for i, s in enumerate(seg)])).alias("k"),
                       F.col("fp").alias("b")).select("k.*", "b")
    probes = fps.select(F.explode(F.array(*[key(i, s.bitwiseXOR(F.lit(m))) for i, s in enumerate(seg)
                                            for m in _masks(width, radii[i])])).alias("k"),
                        F.col("fp").alias("a")).select("k.*", "a")
    crowded = cut_lineage(table.groupBy("seg", "val").count().filter(F.col("count") > crowd).select("seg", "val"))
    pairs = (probes.join(table.join(crowded, ["seg", "val"], "left_anti"), ["seg", "val"])
             .filter((F.col("a") != F.col("b")) & near("a", "b")).select("a", "b"))
    dense = probes.join(crowded, ["seg", "val"], "left_semi").select(F.col("a").alias("fp")).distinct()
    from pyspark.sql import Window
    met = (dense.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(m)))
                                                  for m in _masks(64, max_bits // 2)])).alias("mid"))
           .withColumn("b", F.min("fp").over(Window.partitionBy("mid")))
           .filter((F.col("fp") != F.col("b")) & near("fp", "b")).select(F.col("fp").alias("a"), "b"))
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """``(id, fingerprint, component_id)``: one row per row of ``docs``."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col, words))
    fps = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    links = cut_lineage(hamming_links(fps.select("fp"), max_bits, segments, crowd))
    ends = links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp")))
    parts = connected_components(ends, links, node="fp", src="a", dst="b")
    rooted = fps.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

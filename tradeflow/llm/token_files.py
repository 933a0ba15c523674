"""Token-id files with Elias-Fano document boundaries.

File format (little endian; one file holds one run of documents):

    8 bytes   magic "TFTOKEF1"
    8 x u64   part, seq, number of documents, number of ids, id width in bytes,
              low bits of the boundaries, words of low bits, words of high bits
    i64       doc_id of each document, ascending; u8 1 where the doc_id is null
    ids       unsigned integers of 2 bytes (vocabulary up to 65,536) or 4
    low       the low bits of each boundary, packed
    high      the high parts in unary: bit (high + i) is set for boundary i
    u64       every 256th set bit's position (select samples)
    1 byte    newline, the record end of Spark's text sink

Boundary i is the number of ids before document i's end. ``select(i)`` finds
the i-th set bit of ``high`` from the nearest sample by population counts, so
an offset needs about 2 + log2(ids / documents) bits and no table of 64-bit
integers.

Writing: documents are range-partitioned by id, sorted within each partition,
encoded in order and cut into runs of at most ``run_ids`` ids (a longer
document is a run of its own). Spark's text sink writes each run as one file,
so any file system works and only committed files appear: a lost executor's
task is written again. Reading: Spark's binary reader; the header alone orders
the files.

Encoding: each piece that the tokenizer's pre-tokenizer pattern splits off is
encoded on its own by the tokenizers library's model and remembered for the
worker's later tasks, as pieces do not influence each other; texts with an
added token's string, and tokenizers without this pattern, are encoded whole.

Defined results: a null text is empty and holds only the end id; a null id
sorts first; documents of equal id follow each other by the hash of their
text. Repeated rows stay. An empty table writes no file and gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradeflow.llm.common import map_batches, shared_path, utf8, written

MAGIC, SAMPLE = b"TFTOKEF1", 256
RUN_IDS, MEMO_WORDS = 2_000_000, 1_200_000
# the pre-tokenizer pattern of byte-level BPE; a fixed value
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# plain texts, of ASCII and Latin letters, split alike by the standard library, which is faster, as it is with the letters
# listed and first: no other alternative begins with one
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")
PLAIN = re.compile(rf" [{_LETTERS}]+|[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``, with ``select``."""

    def __init__(self, low_bits: int, low, high, samples, count: int):
        self.low_bits, self.low, self.high, self.samples, self.count = low_bits, low, high, samples, count

    @classmethod
    def of(cls, values, universe: int) -> EliasFano:
        import numpy as np
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(((int(high[-1]) if n else 0) // 64 + 1) * 64, dtype=np.uint8)
        marks[high] = 1
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.concatenate((low, np.zeros(-len(low) % 64, dtype=np.uint8)))
        pack = lambda a: np.packbits(a, bitorder="little").view("<u8")
        return cls(bits, pack(low), pack(marks), high[::SAMPLE].astype("<u8"), n)

    def _low(self, i):
        import numpy as np
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = np.asarray(i, dtype=np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = (shift + np.uint64(self.low_bits)) > 64
        nxt = self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63))
        return np.where(over, out | nxt, out) & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word, bits = at // 64, int(self.high[at // 64]) >> (at % 64) << (at % 64)
        while left >= bits.bit_count():
            left -= bits.bit_count()
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | int(self._low([i])[0])

    def all(self):
        """Every value, as one array."""
        import numpy as np
        marks = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[:self.count]
        high = (marks - np.arange(self.count)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(np.arange(self.count))


def pack(part: int, seq: int, doc_ids: list, ids, ends, width: int) -> bytes:
    """One file's bytes: ``ids`` of all documents, ``ends`` the number of ids up to each one's end."""
    import numpy as np
    ef = EliasFano.of(ends, int(ends[-1]) + 1)
    head = struct.pack("<8Q", part, seq, len(doc_ids), len(ids), width, ef.low_bits, len(ef.low), len(ef.high))
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    null = np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    return b"".join((MAGIC, head, known, null, np.asarray(ids).astype(f"<u{width}").tobytes(), ef.low.tobytes(),
                     ef.high.tobytes(), ef.samples.tobytes()))


def unpack(data: bytes):
    """``(part, seq, doc_ids, ids, boundaries)`` of one file; boundaries is an EliasFano."""
    import numpy as np
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    part, seq, docs, n, width, bits, low, high = struct.unpack_from("<8Q", data, 8)
    at = 72

    def take(kind: str, count: int):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    known, null = take("<i8", docs), take("u1", docs)
    doc_ids = [None if x else int(d) for d, x in zip(known, null)]
    ids = take(f"<u{width}", n)
    ef = EliasFano(bits, take("<u8", low), take("<u8", high), take("<u8", -(-docs // SAMPLE)), docs)
    return part, seq, doc_ids, ids, ef


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: printable bytes stand for
    themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Pieces(dict):
    """Piece -> its ids as bytes; a piece not yet known is encoded by the tokenizer's model."""

    def __init__(self, model, width: int, limit: int):
        super().__init__()
        self.model, self.width, self.limit = model, width, limit
        self.letters = dict(enumerate(_byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        plain = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(plain)])
        if len(self) < self.limit:  # a full memo keeps the pieces seen first, the frequent ones
            self[piece] = ids
        return ids


def _of_worker(name: str, make):
    """What ``make`` gives; made once in the life of a Python worker, over all its tasks."""
    import sys
    held = sys.__dict__.setdefault("_tradeflow_memo", {})
    if name not in held:
        held[name] = make()
    return held[name]


class Encoder:
    """Whole-text ids by the tokenizers library, with remembered pieces."""

    def __init__(self, spec: str, width: int = 4, memo_words: int = MEMO_WORDS):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer, self.width = Tokenizer.from_str(spec), width
        own = json.loads(spec)
        pre = own.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and not own.get("normalizer") and own["model"].get("type") == "BPE")
        self.added = [t["content"] for t in own.get("added_tokens") or ()]
        self.pieces = regex.compile(PIECES)
        self.memo = Pieces(self.tokenizer.model, width, memo_words)

    def __call__(self, text: str) -> bytes:
        """The ids, little endian, that ``encode(text, add_special_tokens=False)`` gives."""
        if not self.by_piece or any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(self.width, "little") for i in ids])
        pieces = (self.pieces if UNUSUAL.search(text) else PLAIN).findall(text)
        return b"".join(map(self.memo.__getitem__, pieces))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
          run_ids: int = RUN_IDS, partitions: int | None = None) -> None:
    """Writes the token files of ``docs`` below ``path``. ``tokenizer``: path of a tokenizer's JSON file on the driver."""
    spec = open(tokenizer, encoding="utf-8").read()
    vocabulary = max([end_id, *json.loads(spec)["model"]["vocab"].values()]) + 1
    width = 2 if vocabulary <= 1 << 16 else 4
    own = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    order = [F.asc_nulls_first("id"), F.xxhash64("text").asc()]
    ranged = own.repartitionByRange(partitions, *order) if partitions else own.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)

    def runs(batches):
        import os

        import numpy as np
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _of_worker(f"{zlib.crc32(spec.encode())}-{width}", lambda: Encoder(spec, width))
        last = end_id.to_bytes(width, "little")
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        ends: list[int] = []
        held: list = []
        total = 0

        def packed():
            return {"file": [pack(part, seq, held, np.frombuffer(b"".join(ids), dtype=f"<u{width}"), ends, width)]}

        for b in batches:
            for key, text in zip(b["id"].to_pylist(), b["text"]):
                found = encode(text.as_py()) + last
                if held and total + len(found) // width > run_ids:
                    yield packed()
                    seq, total = seq + 1, 0
                    ids, ends, held = [], [], []
                ids.append(found)
                total += len(found) // width
                ends.append(total)
                held.append(key)
        if held:
            yield packed()

    files = map_batches(ranged, runs, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the files below ``path``."""
    def documents(batches):
        import numpy as np
        for b in batches:
            for data in b["content"]:
                part, seq, doc_ids, ids, ef = unpack(data.as_py())
                ends = ef.all().astype(np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                wide = np.asarray(ids).astype("<u4")
                yield {"part": [part] * len(ends), "seq": [seq] * len(ends), "id": doc_ids, "at": starts,
                       "n_tokens": ends - starts,
                       "ids_crc32": [zlib.crc32(wide[s:e].tobytes()) for s, e in zip(starts, ends)]}

    found = spark.read.format("binaryFile").load(path).select("content")
    rows = written(map_batches(found, documents, "part long, seq long, id long, at long, n_tokens long, ids_crc32 long"),
                   "token-rows")
    files = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))  # one row per partition written
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    offsets = files.select("part", "seq", before.alias("_s")).join(parts, "part")
    return (rows.join(offsets, ["part", "seq"])
            .select(F.col("id").alias(id_name), (F.col("_p") + F.col("_s") + F.col("at")).alias("start"), "n_tokens",
                    "ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Writes ``docs`` and reads them back; the files stay below ``path`` (new in the shared folder, if None)."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    write(docs, path, tokenizer, end_id, **options)
    return read_documents(spark, path)

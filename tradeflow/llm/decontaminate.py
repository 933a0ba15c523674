"""Benchmark decontamination by template canonicalisation.

Both sides are read as templates: lower-cased word tokens in which numbers,
units and names are replaced by typed placeholders that keep their value as a
slot. A unit is a word of ``UNITS`` after a number; a name is a run of
capitalised words that does not start a sentence. Windows of ``width`` tokens
of the templates are joined on their hash; a window needs ``MIN_LITERALS``
literal words, so that runs of placeholders link nothing.

Each text is read twice: typed as above, and plain, where names stay literal
words, letters are case-folded and a word of ``UNITS`` after a number is a unit
whatever stands between. Capitals and line breaks change nothing in the plain
reading, so copies in upper, lower or title case and rewrapped ones are found
by it; a pair counts if either reading covers it. Windows meet only windows of
the same reading.

With ``exact_windows`` the plain windows of fewer literal words are kept too:
their hash holds their slot values, so that they link equal values only. Items
that have such windows get a third reading of all plain windows, which finds
verbatim copies of items made mainly of numbers and units.

A hit aligns a document position with an item position. Per document, item
and alignment (document minus item position) the slot values must be
consistent: each item value has one document value. A passage with other numbers throughout is a re-parameterised question; one that
maps the same value to different values is only a similar form, and that
alignment does not count. A document is contaminated by an item when
consistent alignments of one reading cover at least ``min_cover`` of the item's
windows (items shorter than a window: the whole item is the window); the row
reports the reading that covers more.

Join: benchmark windows are sent to the tasks when there are at most
``LOCAL_WINDOWS`` of them (checked by a count); documents then emit only hits.
Beyond that the windows of both sides are shuffled and joined. Both ways give
the same rows.

Defined results: null texts are empty and contaminate nothing; items without
any window of enough literals are skipped unless ``exact_windows`` is set, then
only items without any token are. Repeated document rows with one id
count as one document. Rows with a null id are not reported and never removed.
Equal items are reported each. Empty tables give an empty result. Other
columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeflow.llm.common import map_batches, utf8, written

WIDTH, MIN_COVER, MIN_LITERALS, LOCAL_WINDOWS = 5, 0.8, 2, 2_000_000
TYPED, PLAIN, EXACT = 0, 1, 2  # the readings
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres centimeter centimeters mg g kg lb lbs oz gram grams kilogram kilograms
pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds
min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent dollar dollars cent
cents euro euros usd eur gbp hz khz mhz ghz w kw mw v kv a j kj n pa kpa mol k c f kb mb gb tb""".split())

_UPPER = "[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]"  # capitals of the Latin-1, Greek and Cyrillic alphabets
_LETTER = r"[^\W\d_]"
_NUMBER, _UNIT, _NAME = "\x01", "\x02", "\x03"
# the first character tells the alternatives apart, so the search skips to it
_SPECIAL = re.compile(
    rf"[.!?\n\d{_UPPER[1:-1]}](?:(?<=[.!?\n])(?P<start>[^\w]*{_LETTER}+)"
    rf"|(?<=\d)(?P<number>[\d,]*(?:\.\d+)?)(?:[^\w.!?\n]*(?P<unit>(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))"
    rf"(?!{_LETTER}))?"
    rf"|(?<!{_LETTER}.)(?<={_UPPER})(?P<name>{_LETTER}+(?:[ '-]{_UPPER}{_LETTER}+)*))", re.DOTALL)
_TOKEN = re.compile(rf"[\x01\x02\x03]|{_LETTER}+")
_CONTROL = re.compile(r"[\x01\x02\x03]")


def template(text: str | None) -> tuple[list[str], dict[int, str]]:
    """Template tokens, and the value of each placeholder by its position."""
    values: list[str] = []

    def place(m: re.Match) -> str:
        if m.lastgroup == "start":
            return m[0]
        if m.lastgroup == "name":
            values.append(m[0].lower())
            return f" {_NAME} "
        values.append((m[0][0] + m["number"]).replace(",", "").rstrip("."))
        if m["unit"]:
            values.append(m["unit"].lower())
            return f" {_NUMBER} {_UNIT} "
        return f" {_NUMBER} "

    text = "\n" + (text or "")
    if _CONTROL.search(text):
        text = _CONTROL.sub(" ", text)
    tokens = _TOKEN.findall(_SPECIAL.sub(place, text).lower())
    return tokens, (dict(zip((k for k, t in enumerate(tokens) if t <= _NAME), values)) if values else {})


def plain(tokens: list[str], slots: dict[int, str]) -> tuple[list[str], dict[int, str]]:
    """The plain reading of a text from its template: names as words, folded letters, units after any number."""
    if not slots:
        joined = " ".join(tokens)
        return (tokens if joined.isascii() else joined.casefold().split(" ")), {}
    out, kept, after = [], {}, 0
    for k, value in slots.items():  # in the order of their positions
        out += tokens[after:k]
        after = k + 1
        if tokens[k] == _NAME:
            out += _TOKEN.findall(value)
        else:
            kept[len(out)] = value
            out.append(tokens[k])
    out += tokens[after:]
    joined = " ".join(out)
    if not joined.isascii():
        out = joined.casefold().split(" ")
    for k in [k for k, _ in kept.items() if out[k] == _NUMBER and k + 1 < len(out) and out[k + 1] in UNITS]:
        kept[k + 1], out[k + 1] = out[k + 1], _UNIT
    return out, kept


def _signed(x: int) -> int:
    return (x ^ (1 << 63)) - (1 << 63)


def _scan(text: str | None, widths: list[int], only: dict | None):
    """``(position, width, hash, slots)`` of the windows of a text's template with enough literals."""
    return _windows(*template(text), widths, only, TYPED)


def _readings(text: str | None):
    typed = template(text)
    return (TYPED, *typed), (PLAIN, *plain(*typed))


def _sparse(tokens: list[str], slots: dict[int, str], widths: list[int], only: dict | None):
    """The windows of the plain reading without enough literals."""
    return _windows(tokens, slots, widths, only, EXACT, sparse=True) if slots else ()


def _known(tokens: list[str], widths: list[int], only: dict) -> dict[int, list[int]]:
    """For each width the positions of the windows all of whose tokens are words to look for; no other window can match."""
    import numpy as np
    known = np.fromiter(map(only["words"].__contains__, tokens), np.int64, len(tokens))
    known = np.concatenate(([0], np.cumsum(known)))
    return {w: np.flatnonzero(known[w:] - known[:-w] == w).tolist() for w in widths if 1 <= w <= len(tokens)}


def _bytes(tokens: list[str]) -> bytes:
    return " ".join(tokens).encode("utf-8", "surrogatepass")


def _windows(tokens: list[str], slots: dict[int, str], widths: list[int], only: dict | None, reading: int,
             sparse: bool = False, at: dict[int, list[int]] | None = None):
    """Windows of one reading, which seeds their hashes. ``only``: the words and hashes to look for; a window with
    any other word is not hashed. ``sparse``: the windows without enough literals instead, hashed with their values.
    ``at``: the positions by width, if they are known."""
    from bisect import bisect_left

    from xxhash import xxh3_64_intdigest
    if at is None:
        at = {w: range(len(tokens) - w + 1) for w in widths if 1 <= w <= len(tokens)} if only is None else _known(tokens, widths, only)
    held = sorted(slots)
    for w, places in at.items():
        for k in places:
            if sparse:
                inside = held[bisect_left(held, k):bisect_left(held, k + w)]
                if w - len(inside) < min(MIN_LITERALS, w):
                    values = [slots[j] for j in inside]
                    exact = [_bytes(tokens[k:k + w]), *(v.encode("utf-8", "surrogatepass") for v in values)]
                    h = xxh3_64_intdigest(b"\0".join(exact), reading)
                    if only is None or h in only["hashes"]:
                        yield k, w, h, values
                continue
            h = xxh3_64_intdigest(_bytes(tokens[k:k + w]), reading)
            if only is None or h in only["hashes"]:
                inside = held[bisect_left(held, k):bisect_left(held, k + w)]
                if w - len(inside) >= min(MIN_LITERALS, w):
                    yield k, w, h, [slots[j] for j in inside]


def _text_windows(text: str | None, widths: list[int], only: dict | None, exact: bool):
    """The windows of both readings of a document's text, and the sparse ones if ``exact``. Where the readings have the
    same tokens, as in most texts, the words are looked up once for both."""
    at = last = None
    for reading, tokens, slots in _readings(text):
        if only is not None and tokens != last:
            at, last = _known(tokens, widths, only), tokens
        yield from _windows(tokens, slots, widths, only, reading, at=at)
        if exact and reading == PLAIN and slots:
            yield from _windows(tokens, slots, widths, only, EXACT, sparse=True, at=at)


def _hits(docs: DataFrame, widths: list[int], only: dict | None, exact: bool) -> DataFrame:
    """Windows of documents ``(id, text)`` in each of ``widths``, of both readings; ``exact``: the sparse ones too."""
    def found(batches):
        for b in batches:
            rows = [(i, k, w, _signed(h), s) for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist())
                    for k, w, h, s in _text_windows(t, widths, only, exact)]
            yield {n: [r[c] for r in rows] for c, n in enumerate(("id", "pos", "width", "hash", "slots"))}

    return map_batches(docs, found, "id long, pos long, width int, hash long, slots array<string>")


def item_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text",
                 exact: bool = False) -> DataFrame:
    """``(item, reading, at, width, hash, values)``; an item shorter than ``width`` is one window. ``exact``: a third
    reading of the plain windows and the sparse ones, for items that have any of these."""
    def found(batches):
        for b in batches:
            rows = []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                for reading, tokens, slots in _readings(t):
                    w = min(width, len(tokens))
                    full = [(k, w, _signed(h), s) for k, w, h, s in _windows(tokens, slots, [w], None, reading)]
                    rows += [(i, reading, *x) for x in full]
                    if exact and reading == PLAIN:
                        sparse = [(k, w, _signed(h), s) for k, w, h, s in _sparse(tokens, slots, [w], None)]
                        rows += [(i, EXACT, *x) for x in sparse + full if sparse]
                # within a sentence of a document, a capitalised first word reads as a name
                n = len(template(t)[0])
                w = min(width, n)
                inner = f"a {t}"
                if len(template(inner)[0]) == n + 1:
                    rows += [(i, TYPED, k - 1, w, _signed(h), s) for k, w, h, s in _scan(inner, [w], None) if k == 1]
            yield {n: [r[c] for r in rows] for c, n in enumerate(("item", "reading", "at", "width", "hash", "values"))}

    own = items.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).filter(F.col("id").isNotNull())
    schema = "item long, reading int, at long, width int, hash long, values array<string>"
    return map_batches(own, found, schema).distinct()


def _words(items: DataFrame, text_col: str) -> set[str]:
    """The tokens of the items in both readings."""
    def found(batches):
        for b in batches:
            yield {"word": list({_NAME, *(w for t in b["text"].to_pylist() for r in _readings(t) for w in r[1])})}

    own = items.select(utf8(text_col).alias("text"))
    return {r.word for r in map_batches(own, found, "word string").distinct().collect()}


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
                 min_cover: float = MIN_COVER, local_windows: int = LOCAL_WINDOWS,
                 exact_windows: bool = False) -> DataFrame:
    """``(id, item_id, cover, n_windows, verbatim)`` for each contaminated pair; ``verbatim`` is false
    where a slot has another value than in the item. ``exact_windows``: windows of too few literals count where
    their values are equal."""
    own = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).filter(F.col("id").isNotNull())
    bench = item_windows(items, width, item_id, item_text, exact_windows)
    keys = bench.select("hash").distinct()
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # at most ``width`` values
    fits = keys.limit(local_windows + 1).count() <= local_windows
    only = None
    if fits:
        only = {"hashes": {r.hash & (2 ** 64 - 1) for r in keys.collect()}, "words": _words(items, item_text)}
    hits = _hits(own, widths, only, exact_windows).join(F.broadcast(bench) if fits else bench, ["hash", "width"])
    hits = written(hits.withColumn("shift", F.col("pos") - F.col("at")), "hits")  # two branches read them
    pair = ["id", "item", "reading", "shift"]
    slot = hits.select(*pair, F.explode(F.arrays_zip("values", "slots")).alias("s")).select(*pair, "s.*").distinct()
    # an item value with two values in the document breaks its alignment
    broken = (slot.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("values").alias("v"),
                                      F.max(F.col("values") != F.col("slots")).alias("other")))
    sound = (hits.select(*pair, "at").distinct()
             .join(broken, pair, "left").filter(F.coalesce(F.col("n") == F.col("v"), F.lit(True))))
    total = bench.groupBy("item", "reading").agg(F.count_distinct("at").alias("n_windows"))
    covered = (sound.groupBy("id", "item", "reading").agg(F.count_distinct("at").alias("covered"),
                                                          F.max(F.coalesce("other", F.lit(False))).alias("other"))
               .join(total, ["item", "reading"]).filter(F.col("covered") >= F.lit(min_cover) * F.col("n_windows")))
    # a pair that both readings cover: the one that covers more, the typed one of equals
    best = F.max(F.struct((F.col("covered") / F.col("n_windows")).alias("cover"), -F.col("reading"), "n_windows", "other"))
    return (covered.groupBy("id", "item").agg(best.alias("best"))
            .select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "best.cover", "best.n_windows",
                    (~F.col("best.other")).alias("verbatim")))

"""Secret scan: fixed patterns, and a battery of randomness tests over the tokens of a text.

Everything is a DataFrame expression; no Python runs on the executors.

Patterns (kinds assign, access, hex) match leftmost without overlap. Positions
come from the pieces between matches: a match starts after all pieces and
matches before it (running sums in chunks of the square root of their number).

Battery (kind random): candidates are all runs of at least ``min_length`` base-64
characters. The encoding (hex, base 32, base
36, base 64) is the smallest alphabet that holds all characters. Against the
hypothesis "independent uniform symbols of that encoding" three tests give
two-sided p-values: chi-squared of the symbol counts (grouped so that about
five are expected per cell), Wald-Wolfowitz runs above and below the middle of
the alphabet, and lag-1 serial correlation. Fisher's method combines them.
Random strings have uniform p-values, words and paths pile up near 0. For each
class of lengths the corpus-wide histogram of p-values tells how many random
strings there are (twice those above one half) and hence which share of the
tokens with p of at least t is not random. The smallest t with a share of at
most ``false_share`` is the threshold of that class; if none has, the class
makes no claim. Tokens at or above it are reported unless a pattern already
covers them.

Defined results: a null text is an empty one, without spans. Rows with equal
or null ids are rows of their own. An empty table gives an empty result.
Positions count code points, the end is exclusive. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeflow.llm.common import utf8, written

MIN_LENGTH, FALSE_SHARE, P_BINS = 20, 0.05, 20
LENGTH_CLASSES = (24, 32, 48, 64)  # upper limits; longer tokens are the last class

# patterns fixed by the contract
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: name -> (pattern of the whole token, alphabet); the first that fits counts
ENCODINGS = (("hex", "^[0-9a-f]+$", "0123456789abcdef"), ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
             ("base32", "^[A-Z2-7]+$", _LOWER.upper() + "234567"), ("base36", "^[a-z0-9]+$", _DIGITS + _LOWER),
             ("BASE36", "^[A-Z0-9]+$", _DIGITS + _LOWER.upper()),
             ("base64", "^[A-Za-z0-9+/_-]+$", _DIGITS + _LOWER + _LOWER.upper() + "+/"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def running_sums(lengths: Column) -> Column:
    """The sum of all elements before each one, in chunks of the square root of their number."""
    size = F.size(lengths)
    chunk = F.greatest(F.lit(1), F.ceil(F.sqrt(size))).cast("int")

    def body(c: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / c).cast("int")),
                             lambda j: _total(F.slice(lengths, j * c + 1, c)))
        upto = F.aggregate(chunks, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return let(upto, lambda u: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.element_at(
            u, F.floor(i / c).cast("int") + 1) + _total(F.slice(lengths, F.floor(i / c).cast("int") * c + 1, i % c))))

    return let(chunk, body)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<start, end, value>`` of the leftmost non-overlapping matches; ``value`` is the group's text."""
    p = F.lit(pattern)

    def spans(m: Column) -> Column:
        found, between = m["found"], m["between"]
        lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.length(b) + F.length(f))
        starts = let(lengths, running_sums)
        return F.transform(F.arrays_zip(starts.alias("s"), found.alias("f"), F.slice(between, 1, F.size(found)).alias("b"),
                                        m["value"].alias("v")),
                           lambda x: F.struct((x["s"] + F.length(x["b"])).alias("start"),
                                              (x["s"] + F.length(x["b"]) + F.length(x["f"])).alias("end"),
                                              x["v"].alias("value")))

    parts = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"),
                     F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    return F.when(F.regexp_like(text, p), let(parts, spans)).otherwise(none)


def two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by the rational approximation of erfc (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = reduce(lambda a, c: a * t + c, [-1.453152027, 1.421413741, -0.284496736, 0.254829592], F.lit(1.061405429)) * t
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-12), poly * F.exp(-x * x)))


def p_value(token: Column) -> Column:
    """Fisher's combination of the three tests for one token."""
    alphabet = F.coalesce(*[F.when(F.regexp_like(token, F.lit(p)), F.lit(a)) for _, p, a in ENCODINGS])

    def plain(s: Column) -> Column:
        return F.translate(s["token"], "-_", "+/")

    def codes_of(s: Column) -> Column:
        return F.transform(F.split(plain(s), ""), lambda x: F.instr(s["alphabet"], x).cast("double") - 1)

    def symbols_of(s: Column) -> Column:
        """How often each symbol of the alphabet occurs: what the token loses without it."""
        return let(plain(s), lambda t: F.transform(F.split(s["alphabet"], ""), lambda x: (
            F.length(t) - F.length(F.replace(t, x, F.lit("")))).cast("double")))

    def tests(c: Column) -> Column:
        codes, size = c["codes"], c["size"]
        n = F.size(codes).cast("double")
        cells = F.greatest(F.lit(2.0), F.least(size, F.floor(n / 5)))

        def chi(k: Column) -> Column:
            expected = n / k
            # a cell holds the symbols whose code falls in it, one after another; sizes differ by at most one symbol
            first = lambda j: F.ceil(j * size / k)
            each = F.sequence(F.lit(0), (k - 1).cast("int"))
            counts = F.transform(each, lambda j: F.aggregate(F.slice(
                c["symbols"], (first(j) + 1).cast("int"), (first(j + 1) - first(j)).cast("int")), F.lit(0.0), lambda a, v: a + v))
            wide = F.transform(each, lambda j: n / size * (first(j + 1) - first(j)))
            stat = F.aggregate(F.zip_with(counts, wide, lambda o, e: (o - e) * (o - e) / e), F.lit(0.0),
                               lambda a, v: a + v)
            df = k - 1  # Wilson and Hilferty: the cube root is near normal
            return (F.pow(stat / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)) + 0 * expected

        high = F.transform(codes, lambda x: (x >= size / 2).cast("double"))

        def runs(h: Column) -> Column:
            n1 = F.aggregate(h, F.lit(0.0), lambda a, v: a + v)
            n2 = n - n1
            changes = F.aggregate(F.zip_with(F.slice(h, 2, F.size(h)), F.slice(h, 1, F.size(h) - 1),
                                             lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
            mean = 2 * n1 * n2 / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(var > 0, (changes + 1 - mean) / F.sqrt(var)).otherwise(F.lit(6.0))

        centred = F.transform(codes, lambda x: x - (size - 1) / 2)

        def serial(v: Column) -> Column:
            add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
            squares = add(F.transform(v, lambda x: x * x))
            pairs = add(F.zip_with(F.slice(v, 2, F.size(v)), F.slice(v, 1, F.size(v) - 1), lambda a, b: a * b))
            return F.when(squares > 0, pairs / squares * F.sqrt(n)).otherwise(F.lit(6.0))

        half = -(F.log(two_sided(let(cells, chi))) + F.log(two_sided(let(high, runs)))
                 + F.log(two_sided(let(centred, serial))))
        return let(half, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(F.struct(token.alias("token"), alphabet.alias("alphabet")),
               lambda s: let(F.struct(codes_of(s).alias("codes"), symbols_of(s).alias("symbols"),
                                      F.length(s["alphabet"]).cast("double").alias("size")), tests))


def length_class(n: Column) -> Column:
    return reduce(lambda a, k: a + (n >= k).cast("int"), LENGTH_CLASSES, F.lit(0))


def thresholds(found: DataFrame, false_share: float = FALSE_SHARE, bins: int = P_BINS) -> dict[int, float]:
    """Threshold per length class from ``found`` (array column ``candidates`` with start, end, p)."""
    each = found.select(F.explode("candidates").alias("c")).select(
        length_class(F.col("c.end") - F.col("c.start")).alias("k"),
        F.least(F.lit(bins - 1), F.floor(F.col("c.p") * bins)).cast("int").alias("bin"))
    counts: dict[int, list[int]] = {}
    for r in each.groupBy("k", "bin").count().collect():  # at most classes x bins rows
        counts.setdefault(r.k, [0] * bins)[r.bin] = r["count"]
    out = {}
    for k, c in counts.items():
        random = 2 * (sum(c[bins // 2:]) + 1)  # strings whose p-values are uniform
        for t in range(bins // 2 + 1):
            claimed = sum(c[t:])
            if claimed and 1 - random * (1 - t / bins) / claimed <= false_share:
                out[k] = t / bins
                break
    return out


def _as_kind(k: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"], F.lit(k).alias("kind"), m["end"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
         false_share: float = FALSE_SHARE) -> DataFrame:
    """``(id, spans)``: an array of (start, kind number, end) per row, in order; kinds number KINDS."""
    text = utf8(text_col)
    run = f"[A-Za-z0-9+/_-]{{{min_length},}}"
    kept = [F.filter(matches(text, ASSIGN, 1), lambda m: F.length(m["value"]) >= 6), matches(text, ACCESS),
            matches(text, HEX)]
    plain = [F.transform(m, _as_kind(k)) for k, m in enumerate(kept)]
    candidates = F.transform(matches(text, run), lambda m: F.struct(m["start"], m["end"], p_value(m["value"]).alias("p")))
    found = written(docs.select(F.col(id_col), F.concat(*plain).alias("base"), candidates.alias("candidates")), "found")
    limit = thresholds(found, false_share)
    own = F.lit(None).cast("double")
    length = lambda c: c["end"] - c["start"]

    def secret(c: Column) -> Column:
        t = reduce(lambda a, kv: F.when(length_class(length(c)) == kv[0], F.lit(kv[1])).otherwise(a), limit.items(), own)
        free = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return F.coalesce(c["p"] >= t, F.lit(False)) & free

    more = F.transform(F.filter(F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)), secret),
                       _as_kind(KINDS.index("random")))
    return found.select(id_col, F.array_sort(F.concat("base", more)).alias("spans"))

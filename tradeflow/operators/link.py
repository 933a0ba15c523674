"""Text-keyed linkage joins without nested loops.

The reference tests every (name, text) pair: O(names x texts). Here both
joins are *blocked equi-joins followed by an exact verification*, so the
work grows with the number of candidate pairs, not with the product. The
keys of phrases carry the text's 64-bit hash and candidates meet the text again, those of substrings carry the text.

phrase_join (J2) — ``(^|\\W) name (\\W|$)`` on lower-cased text.
    Because the pattern forces a boundary just before and just after the
    match, every maximal ``\\w+`` run of the name is a whole ``\\w+`` token
    of the text, and the name's consecutive tokens are consecutive there. A
    name of two tokens or more is blocked on its rarest pair of consecutive
    tokens, a name of one on that token, a name of none (``#``) on its first
    character; texts emit tokens or characters only if such names exist.

contains_join (J4) — literal, case-sensitive ``name in text``.
    A needle's key is the hash of the whole needle, so what a text meets does not grow
    with the needles that share their parts. Texts emit the windows that pass a set of
    bits of all needles (see ``windows``); what passes by chance is dropped by the join.

Rarity of phrases' keys is measured only for those that occur in some name (a semi-join or filter before
the count). The name side is broadcast where a count shows it to be small; otherwise
what passes a filter of its keys is a shuffle join whose skewed partitions AQE splits. The big side is never collected per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeflow.operators.windows import keys_of, needle_keys
from tradeflow.session import counted, written

_WORD = r"(?U)\w+"
_META = r"([\\^$.|?*+()\[\]{}])"


def regex_quote(c: Column) -> Column:
    """Escape Java-regex metacharacters (safe for any text, unlike ``\\Q..\\E``)."""
    return F.regexp_replace(c, _META, r"\\$1")


def boundary_pattern(name_lower: Column) -> Column:
    """``(?Ud)(^|\\W)<escaped name>(\\W|$)``; ``d`` makes ``$`` match before a final
    ``\\n`` only, as in Python."""
    return F.concat(F.lit(r"(?Ud)(^|\W)"), regex_quote(name_lower), F.lit(r"(\W|$)"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(n: Column) -> Column:
    """1 to n; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def distinct_texts(texts: DataFrame, text_id: str, text_col: Column) -> tuple[DataFrame, DataFrame]:
    """(rows (_rid, _tid, _tv), distinct (_tid, _tv)): rows repeat texts, keys are made once per text. ``_tid`` is the
    text's hash; what is found by it is verified on each row's own text. The rows are written: what made
    the texts is not run again for keys and verification."""
    rows = texts.select(F.col(text_id).alias("_rid"), text_col.alias("_tv")).filter(F.col("_tv").isNotNull())
    rows = written(rows, "texts").withColumn("_tid", F.xxhash64("_tv"))
    return rows, rows.select("_tid", "_tv").distinct()


BROADCAST_KEYS, BROADCAST_BYTES = 200_000, 8 << 20  # of the name side, counted before it is broadcast
FILTER_BITS, RARITY = 1 << 26, 1 << 18  # of the filter at most, and counts of how often keys are met


def key_filter(keys: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """What drops most rows whose (_class, _key) is not among the ``n`` of ``keys``, and none that is: bits set at the
    keys' hashes, in words that a broadcast join looks up. 16 bits a key, at most ``FILTER_BITS`` (a million words)."""
    bits = 1 << 16
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("_class", "_key"), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    words = (keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))

    def keep(df: DataFrame) -> DataFrame:
        own = df.withColumn("_at", at).withColumn("_w", F.shiftright("_at", 6))
        there = (F.col("_w") == F.col("_word")) & (bit.bitwiseAND(F.col("_bits")) != 0)
        return own.join(F.broadcast(words), there, "left_semi").drop("_at", "_w")

    return keep


def candidates(name_keys: DataFrame, tx: DataFrame, text_keys: Callable[[DataFrame], DataFrame], names: list[str],
               ids: Sequence[str] = ("_tid",)) -> DataFrame:
    """(*ids, *names): pairs that share that key of the name which few texts have. ``name_keys`` (*names, _class, _key);
    ``text_keys`` adds (_class, _key) to the texts, distinct per text; ``ids`` are the columns of a text that go along.

    A name side that is counted to be small is broadcast: texts meet it where they are read. Otherwise a filter of
    bounded size drops the texts' keys that no name has, and then those that none is blocked on, before they are
    dealt out. How often a key is met is counted by its hash modulo ``RARITY``, so that the counts stay few."""
    key = ["_class", "_key"]
    name_keys = written(name_keys, "name-keys")
    size = name_keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(names[-1])), F.lit(0))).first()
    small = size[0] <= BROADCAST_KEYS and size[1] <= BROADCAST_BYTES
    keyed = text_keys(tx).select(*ids, *key)
    if small:
        known = keyed.join(F.broadcast(name_keys.select(*key).distinct()), key, "left_semi")
    else:
        known = written(key_filter(name_keys, size[0])(keyed), "known-keys")
    slot = F.pmod(F.xxhash64(*key), F.lit(RARITY)).alias("_slot")
    seen = known.groupBy(slot).agg(F.count(F.lit(1)).alias("_df"))
    chosen = (name_keys.select("*", slot).join(seen, "_slot").groupBy(*names)
              .agg(F.min(F.struct("_df", *key)).alias("_at")).select(*names, "_at.*").drop("_df"))
    chosen = written(chosen, "chosen-keys")
    if small:
        return keyed.join(F.broadcast(chosen), key).select(*ids, *names)
    return key_filter(chosen, chosen.count())(known).join(chosen, key).select(*ids, *names)


PAIR, TOKEN, CHARACTER = 2, 1, 0


def _phrase_keys(c: Column, kind: int) -> Column:
    """Distinct hashes of the text's consecutive token pairs, tokens or non-word characters."""
    if kind == CHARACTER:
        return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\W"), 0), lambda x: F.xxhash64(x)))
    words = F.regexp_extract_all(c, F.lit(_WORD), 0)
    if kind == TOKEN:
        return F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))
    return let(words, lambda t: F.array_distinct(F.transform(
        _steps(F.size(t) - 1), lambda i: F.xxhash64(F.get(t, i - 1), F.get(t, i)))))


def phrase_join(names: DataFrame, texts: DataFrame, *, name_id: str, name_col: str,
                text_id: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All (name, text) pairs where the lower-cased name occurs in the
    lower-cased text bounded by start/end or a non-word character.

    Returns ``(pairs(name_id, text_id), names without any word character)``.
    Null and empty names and null texts match nothing.
    """
    n = names.select(F.col(name_id).alias("_nid"), F.lower(F.col(name_col)).alias("_nl")).filter(F.length("_nl") > 0)
    n_words = F.size(F.regexp_extract_all(F.col("_nl"), F.lit(_WORD), 0))
    n = n.withColumn("_class", F.least(n_words, F.lit(PAIR)))
    kinds = sorted(r[0] for r in n.select("_class").distinct().collect())  # three at most
    rows, tx = distinct_texts(texts, text_id, F.lower(F.col(text_col)))
    pairs, chars = None, n.filter(F.col("_class") == CHARACTER).select(F.col("_nid").alias(name_id), F.col("_nl").alias(name_col))
    if not kinds:
        return rows.join(n, F.lit(False)).select(F.col("_nid").alias(name_id), F.col("_rid").alias(text_id)), chars
    for kind in kinds:
        own = n.filter(F.col("_class") == kind)
        if kind == CHARACTER:
            keys = own.select("_nid", "_nl", "_class", F.xxhash64(F.substring("_nl", 1, 1)).alias("_key"))
        else:
            keys = own.select("_nid", "_nl", "_class", F.explode(_phrase_keys(F.col("_nl"), kind)).alias("_key"))
        found = candidates(keys, tx, lambda t, kind=kind: t.select("_tid", "_tv", F.lit(kind).alias("_class"), F.explode(
            _phrase_keys(F.col("_tv"), kind)).alias("_key")), ["_nid", "_nl"])
        pairs = found if pairs is None else pairs.unionByName(found)
    # a literal search first: the pattern, one per name, is compiled for near matches only
    verified = pairs.distinct().join(counted(rows), "_tid").filter((F.instr(F.col("_tv"), F.col("_nl")) > 0)
                                                          & F.rlike(F.col("_tv"), boundary_pattern(F.col("_nl"))))
    return verified.select(F.col("_nid").alias(name_id), F.col("_rid").alias(text_id)), chars


def contains_keys(needles: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The keys (_nid, _nv, _class, _key) of needles (_nid, _nv), written, and a function that adds (_class, _key) to texts (_tid, _tv)."""
    own = written(needle_keys(needles, "_nv").filter(F.col("_length") > 0), "needle-keys")
    return own.drop("_length", "_lead"), keys_of(own, own.count(), "_tv")


def contains_candidates(needles: DataFrame, texts: DataFrame, ids: Sequence[str] = ("_tid",)) -> DataFrame:
    """Pairs ``(*ids, _nid, _nv)`` of a needle and a text with a window of its key; ``needles`` (_nid, _nv), ``texts`` (_tid, _tv)."""
    own, their = contains_keys(needles)
    size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_nv")), F.lit(0))).first()
    small = size[0] <= BROADCAST_KEYS and size[1] <= BROADCAST_BYTES
    return their(texts).join(own.hint("broadcast" if small else "merge"), ["_class", "_key"]).select(*ids, "_nid", "_nv")


def contains_join(needles: DataFrame, texts: DataFrame, *, needle_id: str, needle_col: str,
                  text_id: str, text_col: str, stored: bool = False, tasks: int = 0) -> DataFrame:
    """All (needle, text) pairs where ``needle`` is a literal substring of ``text``.

    Null/empty needles match nothing here (an empty needle would pair with
    every text). ``texts`` may hold several rows per ``text_id`` (e.g. one
    per text column); the result is distinct on (needle_id, text_id). A row's text goes
    with its keys, of which few pass the filter of needles' keys, and is verified
    where it meets the needle: matches, which may be many times the texts, move without
    texts. ``stored``: the texts are cheap to read again. ``tasks``: pairs are dealt by text alone over
    so many tasks, and what joins them on the text deals them no more.
    """
    nd = needles.select(F.col(needle_id).alias("_nid"), F.col(needle_col).alias("_nv")) \
        .filter(F.col("_nv").isNotNull() & (F.length("_nv") > 0)).distinct()
    rows = texts.select(F.col(text_id).alias("_rid"), F.col(text_col).alias("_tv")).filter(F.col("_tv").isNotNull())
    rows = rows if stored else written(rows, "texts")
    verified = contains_candidates(nd, rows, ["_rid", "_tv"]).filter(F.instr(F.col("_tv"), F.col("_nv")) > 0)
    pairs = verified.select(F.col("_nid").alias(needle_id), F.col("_rid").alias(text_id))
    return (pairs.repartition(tasks, text_id) if tasks else pairs).distinct()


def prefer_exact(links: DataFrame, *, group: str, exact: Column | str) -> DataFrame:
    """J4 exact-preference: if any linked row of a group is exact, keep only the
    exact ones. The flagged links are written once; exact ones stay as they are, the others
    meet the groups that have some (no window over the linked rows, so a hot group is not
    sorted in one task). A null group has no links."""
    ex = F.col(exact) if isinstance(exact, str) else exact
    flagged = written(links.filter(F.col(group).isNotNull())
                      .withColumn("_exact", F.coalesce(ex.cast("boolean"), F.lit(False))), "flagged-links")
    own = flagged.filter("_exact").drop("_exact")
    return own.unionByName(flagged.filter("NOT _exact").drop("_exact").join(own.select(group).distinct(), group, "left_anti"))

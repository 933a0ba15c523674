"""Language ID, spelling variants and hard negatives against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradeflow.llm import language, negatives, spelling

DOCS = "doc_id long, text string, lang string, bits double, gram int, n long, word string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, 3, 4, "x") for i, t, lang in rows], DOCS)


# -- language ---------------------------------------------------------------

VOWELS = {"aa": "the of and ing ion er".split(), "bb": "der und sch ein ü ß lich".split(), "cc": "que les é eau ment ç".split()}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(VOWELS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def plain_lengths(examples, text, least):
    """Code lengths by walking every byte down the orders, from dictionaries."""
    def prepared(t):
        return (" " * language.ORDER + re.sub("[0-9]", "", t.lower())).encode()

    out = {}
    for lang, texts in examples.items():
        seen = Counter()
        for t in texts:
            b = prepared(t)
            for i in range(language.ORDER, len(b)):
                for k in range(language.ORDER + 1):
                    seen[b[i - k:i + 1]] += 1
        total, left = Counter(), Counter()
        for g, n in seen.items():
            total[g[:-1]] += n
            left[g[:-1]] += 2 * n - 1 if n >= least else 0
        kept = {g: n for g, n in seen.items() if n >= least}
        known = {g[:-1] for g in kept}
        bits, b = 0.0, prepared(text)
        for i in range(language.ORDER, len(b)):
            for k in range(language.ORDER, -1, -1):
                g = b[i - k:i + 1]
                if g in kept:
                    bits -= math.log2((2 * kept[g] - 1) / (2 * total[g[:-1]]))
                    break
                if g[:-1] in known:
                    bits -= math.log2(1 - left[g[:-1]] / (2 * total[g[:-1]]))
            else:
                bits += 8
        out[lang] = bits
    return out


def trained(spark, r, cells=language.MAX_CELLS):
    rows = [(i, sentence(r, lang, 30), lang) for i, lang in enumerate(list(VOWELS) * 12)]
    return rows, language.learn(docs(spark, rows), max_cells=cells)


@pytest.mark.parametrize("cells", [language.MAX_CELLS, 900])
def test_code_lengths_are_those_of_the_plain_trees(spark, cells):
    r = random.Random(11)
    rows, trees = trained(spark, r, cells)
    by = defaultdict(list)
    for _, t, lang in rows:
        by[lang].append(t)
    assert trees.langs == sorted(by)
    sizes = sum(len(g) for g in trees.grams)
    least = 1
    if cells == 900:  # the smallest count at which the pairs fit
        all_pairs = Counter()
        for lang, texts in by.items():
            for t in texts:
                b = (" " * language.ORDER + t).encode()
                for i in range(language.ORDER, len(b)):
                    for k in range(language.ORDER + 1):
                        all_pairs[lang, b[i - k:i + 1]] += 1
        least = min(t for t in range(1, 10_000) if 3 * sum(n >= t for n in all_pairs.values()) <= cells)
        assert least > 1 and sizes <= 300
    texts = ["", "the", "ß", "日本語 text", "12 34", "x" * 50, *[sentence(r, lang, n) for lang in VOWELS for n in (1, 5, 40)]]
    prepared = pa.array([" " * language.ORDER + re.sub("[0-9]", "", t) for t in texts])
    got = trees.of_texts(prepared)
    for t, bits in zip(texts, got):
        want = plain_lengths(by, t, least)
        assert bits == pytest.approx([want[x] for x in trees.langs], abs=1e-6), t
    # kept bytes and escape share out each context's whole probability, so no more than that is coded
    first = np.exp2(-trees.bits[0]).sum(axis=0)
    assert (first <= 1 + 1e-9).all() and (first > 0.9).all()


def test_long_texts_and_batches_do_not_change_code_lengths(spark, monkeypatch):
    r = random.Random(5)
    _, trees = trained(spark, r)
    texts = [" " * language.ORDER + sentence(r, lang, n) for lang in VOWELS for n in (1, 300, 3000)] + ["", " " * language.ORDER]
    whole = trees.of_texts(pa.array(texts))
    monkeypatch.setattr(language, "STEP", 97)
    monkeypatch.setattr(language.pieces, "__defaults__", (97,))
    assert np.allclose(trees.of_texts(pa.array(texts)), whole)
    assert np.allclose(trees.of_texts(pa.array(["zz", *texts]).slice(1)), whole)  # an array that starts inside its buffers


def test_held_out_documents_are_told_apart_and_odd_rows_have_defined_results(spark):
    r = random.Random(7)
    rows = [(i, sentence(r, lang, 25), lang) for i, lang in enumerate(list(VOWELS) * 60)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 3!?", "cc"), (None, sentence(r, "bb", 20), "aa"), (1004, sentence(r, "cc", 9), None),
           (0, rows[0][1], "aa"), (1005, "É", None), (1006, "THE OF AND INGION " * 4000, None)]
    d = docs(spark, rows + odd)
    held_out = F.coalesce(language.fold() == 2, F.lit(False))
    got = language.identified(d, ~held_out).collect()
    assert len(got) == len(rows) + len(odd)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    fold = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(fold) > 30
    right = sum(by[i][0].lang_pred == lang for i, _, lang in rows if i in fold)
    assert right >= 0.98 * len(fold)
    for i in (1000, 1001, 1002):
        assert (by[i][0].lang_pred, by[i][0].score, by[i][0].bits) == ("und", 0.0, None)
    assert by[None][0].lang_pred == "bb" and by[1004][0].lang_pred == "cc" and by[1006][0].lang_pred == "aa"
    assert len(by[0]) == 2 and by[0][0] == by[0][1]
    assert by[1005][0].lang_pred in ("bb", "cc") and all(0 <= x.score <= 1 for x in got)


def test_labels_of_the_held_out_fold_and_ids_never_count(spark):
    r = random.Random(9)
    rows = [(i, sentence(r, lang, 25), lang) for i, lang in enumerate(list(VOWELS) * 20)]
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    held_out = F.coalesce(language.fold() == 2, F.lit(False))
    one, two = (sorted(language.identified(docs(spark, x), ~held_out).collect()) for x in (rows, lied))
    assert one == two


def test_language_without_rows_or_labels(spark):
    none = docs(spark, [])
    assert language.identified(none, F.lit(True)).collect() == []
    assert [x.lang_pred for x in language.identified(docs(spark, [(1, "abc", None)]), F.lit(True)).collect()] == ["und"]


def test_examples_are_bounded_whole_and_chosen_alike(spark):
    r = random.Random(3)
    rows = [(i, sentence(r, "aa", 3), "aa") for i in range(400)] + [(500, "one and the same", "bb")] * 300
    few = language.examples(docs(spark, rows), 20).collect()
    assert Counter(x.lang for x in few) == {"aa": 20, "bb": 1}
    again = language.examples(docs(spark, random.Random(1).sample(rows, len(rows))).repartition(7), 20).collect()
    assert sorted(few) == sorted(again)


# -- spelling ---------------------------------------------------------------

def plain_words(rows, noise=199):
    seen = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[:h % len(run)] + run[h % len(run) + 1:] if h % noise == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, noise=199):
    n = plain_words(rows, noise)
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = [n[w], len(near), form, n[form] if form else None]
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        out[w].append(at)
    return {w: tuple(x) for w, x in out.items()}


def got_variants(df):
    return {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in df.collect()}


@pytest.mark.parametrize("alphabet, noise", [("ab", 199), ("abé", 3), ("abcdefgß", 50)])
def test_variants_equal_the_plain_ones(spark, alphabet, noise):
    r = random.Random(len(alphabet))
    vocabulary = ["".join(r.choice(alphabet) for _ in range(r.randrange(5, 10))) for _ in range(60)]
    rows = []
    for i in range(150):
        picked = [r.choice(vocabulary[:1 + r.randrange(60)]) for _ in range(40)]
        picked = [w[:k] + r.choice(["", r.choice(alphabet), w[k] + r.choice(alphabet)]) + w[k + 1:] if r.random() < 0.3 else w
                  for w in picked for k in [r.randrange(len(w))]]
        rows.append((i, r.choice([" ", ", ", "1", "\n×"[:1]]).join(w.upper() if w.isascii() and r.random() < 0.1 else w for w in picked), None))
    want = plain_variants(rows, noise)
    assert sum(x[2] is not None for x in want.values()) >= 3 and any(x[4] != x[2] for x in want.values() if x[2]) or noise != 199
    assert got_variants(spelling.variants(docs(spark, rows), noise=noise)) == want


def test_forms_chain_to_their_root_and_ties_go_to_the_smaller(spark):
    text = {"rabbits": 700, "rabbit": 130, "rabbet": 25, "rabbbet": 5, "planets": 30, "planeta": 30, "planet": 6, "ÀÉabcdef": 5, "short": 50}
    rows = [(k, " ".join([w] * n), None) for k, (w, n) in enumerate(text.items())]
    got = got_variants(spelling.variants(docs(spark, rows), noise=10 ** 9))
    assert got["rabbbet"] == (5, 1, "rabbet", 25, "rabbits")
    assert got["planet"][2:] == ("planeta", 30, "planeta") and got["planets"][1:] == (2, None, None, "planets")
    assert got["ÀÉabcdef"][0] == 5 and "short" not in got  # only A-Z are lower-cased


def test_spelling_of_odd_rows(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, None, None), (2, "", None), (None, "few words here", None)])).collect() == []
    long = "x" * 30_000
    rows = [(None, " ".join([long] * 5), None), (1, " ".join([long + "y"] * 30), None), (1, "repeat repeat", None), (1, "repeat repeat repeat", None)]
    got = got_variants(spelling.variants(docs(spark, rows), noise=10 ** 9))
    assert got == plain_variants(rows, 10 ** 9) and got[long][2] == long + "y"


# -- hard negatives ---------------------------------------------------------

def plain_negatives(rows, k=5):
    own = {(i, lab, tuple(max(-negatives.LIMIT, min(negatives.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v)) for i, lab, v in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in own:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in own if b[0] != a[0] and len(b[2]) == len(a[2])]
        for s, p, _ in sorted(x for x in scored if x[2] == a[1])[:k]:
            fit = sorted(x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out += [(a[0], p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **sizes):
    full = [(i, v, lab, 1, "x", 2) for i, lab, v in rows]
    d = spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, len int, mark string, block long")
    got = negatives.hard_negatives(d, F.col("id") % 100 == 0, **sizes).collect()
    return sorted((x.anchor_id, x.positive_id, x.rank, x.negative_id, x.positive_score, x.negative_score) for x in got)


@pytest.mark.parametrize("dims, spread, block", [(1, 0.0, 7), (5, 0.3, 64), (24, 0.6, 150), (9, 0.05, 16_384)])
def test_negatives_equal_all_pairs(spark, dims, spread, block):
    r = np.random.default_rng(dims)
    centres = r.normal(size=(3, dims))
    rows = [(i * 10, int(c), (centres[c] + spread * r.normal(size=dims)).tolist()) for i, c in enumerate(r.integers(0, 3, 600))]
    rows = [(i, int(r.integers(0, 3)) if r.random() < 0.3 else lab, v) for i, lab, v in rows]
    rows += [(100_000 + i, 1, rows[7][2]) for i in range(40)]  # ties
    want = plain_negatives(rows)
    assert want
    assert mined(spark, rows, block=block, anchor_block=9) == want


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.85, 0.0]), (2, 2, [0.8, 0.0]), (3, None, [1.0, 0.0]), (4, 2, None),
            (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (8, 2, [0.9, 0.0, 0.0]), (9, 2, []), (100, 3, []), (200, 3, []),
            (None, 2, [0.9, 0.0]), (300, 5, [1e30, -1e30]), (10, 5, [1e30, 0.0]), (11, 6, [0.9e30, 1.0])]
    want = plain_negatives(rows)
    assert (0, 1, 1, 2, 230 * 256, 217 * 256) in want and len(want) > 3
    assert mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, rows[2:6]) == []


def test_the_scan_drops_rows_before_the_last_dimension():
    r = np.random.default_rng(1)
    m = np.floor(256 * np.concatenate([r.normal(size=16) * 0.6 + 0.05 * r.normal(size=(300, 16)) for _ in range(8)])).astype(np.int32).T
    order = negatives._halved(m, negatives.SEGMENT)
    assert sorted(order) == list(range(m.shape[1]))
    m = np.ascontiguousarray(m[:, order])
    block = negatives.Block(16, m.shape[1], np.arange(m.shape[1]).tobytes(), np.zeros(m.shape[1], np.int64).tobytes(), m.tobytes())
    left = []

    def keep(lower, upper):
        out = negatives.top(5)(lower, upper)
        left.append(int(out.sum()))
        return out

    q = m[:, 11].astype(np.int64)
    rows, score = block.scan(q, np.ones(m.shape[1], bool), keep)
    exact = q @ m.astype(np.int64)
    assert set(np.argsort(-exact, kind="stable")[:5]) <= set(rows) and (score == exact[rows]).all()
    assert left[0] < m.shape[1] and left[1] < m.shape[1] / 4 and left == sorted(left, reverse=True), left

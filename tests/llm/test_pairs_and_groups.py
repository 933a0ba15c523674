"""SimHash, sharding, mixing and nearest neighbours against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tradeflow.llm import mixing, neighbours, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard string, tokens string, _g int"


def docs(spark, rows, sources=None):
    full = [(i, t, None, (sources or {}).get(i), None, "x", "y", "z", 7) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def words(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(prints)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_fingerprint_matches_plain_python():
    r = random.Random(3)
    for text in [None, "", " \t", "One", "one two", "A b C d", "É e", words(r, 400), "x " * 5000, "a\x0bb\x1cc d"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


@pytest.mark.parametrize("crowd", [1, 4, 1000])
def test_links_have_the_components_of_all_pairs(spark, crowd):
    r = random.Random(crowd)
    prints = set()
    for _ in range(40):  # dense groups, chains and loners
        c = r.getrandbits(64)
        prints.add(c)
        for _ in range(r.choice([0, 1, 12])):
            c ^= 1 << r.randrange(64)
            prints.add(c if r.random() < .7 else c ^ (1 << r.randrange(64)))
    signed = lambda x: (x ^ (1 << 63)) - (1 << 63)
    links = simhash.hamming_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), crowd=crowd).collect()
    assert all(((x.a ^ x.b) & (2 ** 64 - 1)).bit_count() <= 2 for x in links)
    want = plain_components(prints, 2)
    root = {signed(f): signed(f) for f in prints}
    changed = True
    while changed:
        changed = False
        for x in links:
            low = min(root[x.a], root[x.b])
            changed |= root[x.a] != low or root[x.b] != low
            root[x.a] = root[x.b] = low
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({signed(k): signed(v) for k, v in want.items()}) == groups(root)


def test_near_duplicates_with_nulls_copies_and_clashing_columns(spark):
    r = random.Random(1)
    base = words(r, 200)
    rows = [(5, base), (3, base), (3, base), (9, base + " more"), (1, None), (2, ""), (4, "\n"), (None, base),
            (None, "only one"), (7, words(r, 100)), (8, "long " * 30000)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    want = plain_components({plain_fingerprint(t) for _, t in rows}, 2)
    ids = defaultdict(list)
    for i, t in rows:
        if i is not None:
            ids[want[plain_fingerprint(t)]].append(i)
    expected = Counter((i, f"{plain_fingerprint(t):016x}", min(ids[want[plain_fingerprint(t)]], default=None))
                       for i, t in rows)
    assert Counter(map(tuple, got)) == expected
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_odd_distances_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.hamming_links(spark.createDataFrame([(1,)], "fp long"), max_bits=3)


def check_shards(rows, got, shards):
    assert Counter((x.doc_id, x.text_crc32) for x in got).total() == len(rows)
    load = Counter(x.shard for x in got)
    if rows:
        assert max(load.values()) - min(load[s] for s in range(shards)) <= 1
    for s in load:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(load[s]))


@pytest.mark.parametrize("case", ["mixed", "one group", "all pairs", "empty"])
def test_sharding_keeps_counts_even_and_groups_together(spark, case):
    r = random.Random(5)
    rows = {"mixed": [(i, f"text {i if i % 3 else i % 9}") for i in range(300)] + [(None, None), (None, ""), (7, "é")],
            "one group": [(i, "same") for i in range(60)] + [(100 + i, f"t{i}") for i in range(40)],
            "all pairs": [(i, f"t{i // 2}") for i in range(64)], "empty": []}[case]
    r.shuffle(rows)
    got = sharding.sharded(docs(spark, rows), shards=4).collect()
    check_shards(rows, got, 4)
    assert all(x.law == "rows" and x.grown_shard is None for x in got)
    places = defaultdict(set)
    for x in got:
        places[x.text_crc32].add(x.shard)
    if case == "mixed":
        assert sum(len(p) > 1 for p in places.values()) <= 3  # quotas may cut a few
    if case == "one group":
        assert max(map(len, places.values())) == 3  # 60 rows need three shards of 25
    if case == "all pairs":
        assert sum(len(p) == 1 for p in places.values()) >= 24  # by exchange alone


def test_quotas_never_overfill():
    r = random.Random(2)
    for _ in range(200):
        asked = {(a, b): r.randrange(20) for a in range(4) for b in range(4) if a != b}
        room = [r.randrange(6) for _ in range(4)]
        q = sharding._quotas(asked, room)
        for s in range(4):
            come, go = sum(n for (a, b), n in q.items() if b == s), sum(n for (a, b), n in q.items() if a == s)
            assert come - go <= room[s]
        assert all(n <= asked[k] for k, n in q.items())


def mixed_rows(seed=4):
    r = random.Random(seed)
    source = lambda k: "hot" if k < 300 else (None if k < 330 else f"s{k % 4}")
    rows = [(k, words(r, r.randrange(1, 60))) for k in range(500)] + [(500, None), (501, "")]
    return rows, {k: source(k) for k, _ in rows}


def test_mixture_meets_its_budget_per_source(spark):
    rows, sources = mixed_rows()
    got = mixing.mixture(docs(spark, rows, sources), blocks=16).collect()
    tokens = {i: len((t or "").split()) for i, t in rows}
    held = Counter()
    for i in tokens:
        held[sources[i]] += tokens[i]
    total = sum(held.values())
    weight = {x.source: x.weight for x in got}
    assert set(weight) == set(held) and abs(sum(weight.values()) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert abs(entropy - 0.95 * math.log(len(weight))) < 1e-6  # bisected: neither more nor less
    a = {s: math.log(weight[s] / weight["hot"]) / math.log(held[s] / held["hot"]) for s in weight if s != "hot"}
    assert max(a.values()) - min(a.values()) < 1e-6  # one exponent for all
    drawn, times = Counter(), Counter()
    for x in got:
        assert x.n_tokens == tokens[x.doc_id]
        drawn[x.source] += x.n_tokens
        times[x.doc_id, x.epoch] += 1
    assert set(times.values()) == {1}
    for s in held:
        due = math.floor(total * weight[s])
        assert due - 60 < drawn[s] <= due
        n = Counter(x.doc_id for x in got if x.source == s)
        whole = due // held[s]
        assert all(whole <= n[i] <= whole + 1 for i in tokens if sources[i] == s)
        last = [x for x in got if x.source == s and x.epoch == whole]  # leading blocks, one of them cut
        for x in last:
            block = {i for i, _ in rows if sources[i] == s and any(y.doc_id == i and y.block == x.block for y in got)}
            taken = {y.doc_id for y in last if y.block == x.block}
            if taken != block:
                assert x.turn == max(y.turn for y in last)


def test_mixture_repeat_limit_and_edges(spark):
    rows, sources = mixed_rows()
    got = mixing.mixture(docs(spark, rows, sources), blocks=16, target_entropy=1.0, max_repeats=2.0).collect()
    assert max(Counter(x.doc_id for x in got).values()) <= 3  # two whole epochs and a part by rounding
    assert mixing.mixture(docs(spark, [])).count() == 0
    assert mixing.mixture(docs(spark, [(1, None), (2, "")])).count() == 0
    same = mixing.drawn_documents(docs(spark, rows, sources), blocks=16)
    assert same.columns == docs(spark, []).columns
    plain = Counter(x.doc_id for x in mixing.mixture(docs(spark, rows, sources), blocks=16).collect())
    assert Counter(x.doc_id for x in same.collect()) == plain


def vectors(seed, n, dims=16, copies=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) + 2 * r.normal(size=(5, dims))[r.integers(0, 5, n)]
    x = x * r.uniform(0.5, 2, (n, 1))
    x[:copies] = x[0]
    return x.astype(np.float32)


def exact(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("copies", [0, 700])
def test_neighbours_recall_scores_and_order(spark, copies):
    x = vectors(1, 2000, copies=copies)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, key int, id double")
    got = neighbours.nearest(table, block_rows=500, least=50).collect()
    want = exact(rows)
    found = defaultdict(list)
    for g in sorted(got, key=lambda g: (g.query_id, g.rank)):
        found[g.query_id].append((g.vec_id, g.score))
    assert set(found) == set(want)
    hits = 0
    for q, near in want.items():
        assert [s for _, s in found[q]] == sorted((s for _, s in found[q]), reverse=True) and len(found[q]) == 20
        assert all(abs(s - float(x[i].astype(float) @ x[q].astype(float))) < 1e-9 for i, s in found[q])
        hits += len({i for i, _ in near} & {i for i, _ in found[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_neighbours_leave_out_unsound_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, []), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [9.0, 9.0]), (20, [1.0, 0.0]), (40, [0.0, 0.0]), (9, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(g.query_id, g["rank"]): (g.vec_id, g.score) for g in neighbours.nearest(table).collect()}
    assert got == {(0, 1): (1, 2.0), (0, 2): (8, 1.0), (0, 3): (20, 1.0), (20, 1): (1, 2.0), (20, 2): (0, 1.0), (20, 3): (8, 1.0)}
    assert neighbours.nearest(table.limit(0)).count() == 0

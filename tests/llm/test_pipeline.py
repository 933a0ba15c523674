"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.test_pairs_and_groups import plain_components, plain_fingerprint


def prose(r, n):
    return " ".join("".join(r.choice("aeinorst") for _ in range(r.randrange(2, 9))) for _ in range(n))


ITEM = "the seven quiet rivers bend north before any traveller can reach the old stone bridge"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, row string, count long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    rows, labels = [], []
    for k in range(600):
        toxic = int(k % 6 == 0)
        text = prose(r, 60) + (" zorkface" if toxic else "")
        rows.append((k, text))
        labels.append((k, 1, toxic))
    clean = [t for k, t in rows if k % 6]
    rows += [(1000 + k, t) for k, t in enumerate(clean[:40])]  # exact copies
    rows += [(1100, f"{prose(r, 20)} {ITEM} {prose(r, 20)}"), (1101, None), (1102, ""), (None, prose(r, 50)), (None, None),
             (1103, prose(r, 40) + " zorkface"), (7, dict(rows)[7]), (1104, prose(r, 30000))]
    full = [(i, t, "en", "hot" if n % 3 == 0 else f"s{n % 5}", None, "a", 1, "b", 2) for n, (i, t) in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(row):
    return row.doc_id, row.text


def test_stages_keep_clean_rows_and_their_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "decontamination", "mixture", "shards"]

    kept = stages["toxicity"](spark, docs, corpus)
    assert kept.columns == columns
    gone = Counter(map(key, docs.collect())) - Counter(map(key, kept.collect()))
    assert sum("zorkface" in (t or "") for _, t in gone) >= 99 and sum("zorkface" not in (t or "") for _, t in gone) <= 2

    rows = kept.collect()
    alone = stages["near_copies"](spark, kept, corpus)
    assert alone.columns == columns
    group = plain_components({plain_fingerprint(x.text) for x in rows}, 2)
    of = lambda x: group[plain_fingerprint(x.text)]
    left = alone.collect()
    assert sorted(map(of, left)) == sorted(set(map(of, rows)))  # one of each group
    least = {}
    for x in rows:
        if x.doc_id is not None:
            least[of(x)] = min(x.doc_id, least.get(of(x), x.doc_id))
    assert all(x.doc_id is None or x.doc_id == least[of(x)] for x in left)

    unseen = stages["decontamination"](spark, alone, corpus)
    assert unseen.columns == columns
    assert Counter(map(key, left)) - Counter(map(key, unseen.collect())) == Counter({key(x): 1 for x in left if x.doc_id == 1100})

    mixed = stages["mixture"](spark, unseen, corpus)
    assert mixed.columns == columns and set(map(key, mixed.collect())) <= set(map(key, unseen.collect()))

    placed = stages["shards"](spark, mixed, corpus)
    got = placed.collect()
    assert Counter(map(key, got)) == Counter(map(key, mixed.collect()))
    load = Counter(x.shard for x in got)
    assert max(load.values()) - min(load.get(s, 0) for s in range(16)) <= 1
    for s in load:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(load[s]))
    assert placed.columns.count("shard") == 1 and placed.columns.count("size") == 1


def test_near_copies_of_one_id_with_unlike_texts(spark, tmp_path):
    r = random.Random(19)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (6, a), (3, c), (9, c), (9, d), (None, d)]
    full = [(i, t, "en", "s", None, "a", 1, "b", 2) for i, t in rows]
    left = dict(pipeline.STAGES)["near_copies"](spark, spark.createDataFrame(full, SCHEMA), str(tmp_path)).collect()
    assert Counter(map(key, left)) == Counter({(5, a): 1, (5, b): 1, (3, c): 1, (None, d): 1})


def test_run_and_empty_table(spark, corpus, tmp_path):
    assert pipeline.run(spark, corpus).count() > 300
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered_once_each():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geopatch.llm import near_copies


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} - {()})


def plain(rows):
    """Ids that are no copy of an earlier id at 0.8 or more."""
    sets = sorted((i, shingles(t)) for i, t in rows)
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return [i for k, (i, s) in enumerate(sets) if not any(near(s, other) for _, other in sets[:k])]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(60)]
    texts = [[rng.choice(words) for _ in range(rng.randint(1, 150))] for _ in range(60)]
    texts += [[*common, *(rng.choice(words) for _ in range(rng.randint(5, 20)))] for _ in range(60)]
    for _ in range(200):
        copy = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    rng.shuffle(texts)
    return [*enumerate(" ".join(t) for t in texts), (900, None), (901, ""), (902, "one two"), (903, "one two")]


@pytest.mark.parametrize("many", [64, 3])
def test_against_all_pairs(spark, rows, monkeypatch, many):
    monkeypatch.setattr(near_copies, "MANY", many)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r["doc_id"] for r in near_copies.keep_first(docs).collect())
    assert left == plain(rows)
    assert 60 < len(left) < 250


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (2, "a b c"), (3, "x"), (3, "y"), (3, "y")], "doc_id long, text string")
    left = near_copies.keep_first(docs)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", "a b c"), ("3", "x"), ("3", "y"), ("None", "a b c"), ("None", "a b c")]
    assert near_copies.keep_first(docs.limit(0)).collect() == []


def test_the_pipeline_drops_copies_at_085(spark):
    rng = random.Random(6)
    text = [f"w{rng.randrange(5000)}" for _ in range(200)]
    copy = list(text)
    for at in (30, 90, 150):
        copy[at] = "other"
    other = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate((text, copy, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2]


def test_rows_left_out_from_the_start(spark, rows):
    twice = [*rows, *((i, t) for i, t in rows if i % 7 == 0), (None, rows[0][1])]
    docs = spark.createDataFrame(twice, "doc_id long, text string")
    out = docs.where("doc_id % 3 = 0")
    expected = sorted(plain([(i, t) for i, t in rows if i % 3]))
    without = out.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"))
    left = [r["doc_id"] for r in near_copies.keep_first(docs, without=without).collect()]
    assert left.count(None) == 1 and sorted(i for i in left if i is not None) == expected


def test_keys_are_shuffled_once(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(near_copies, "later_copies", lambda rows, members, *a: seen.append(members) or members.select("node").limit(0))
    near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(keys") == 1

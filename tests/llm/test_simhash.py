import random

import pytest
import xxhash
from pyspark.sql import functions as F

from geopatch.llm import components, simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for blank in "\t\n\r\x0b\x0c":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two", "A b C d e", "Äpfel ÄPFEL x y z a\x0bb", "w " * 40000])
def test_majority(text):
    assert simhash.majority(text) == plain(text)


def test_masks_cover_every_pair_within_the_radius():
    for radius in (2, 4):
        masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
        rng = random.Random(radius)
        for _ in range(3000):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("small", [64, 1])
def test_links_connect_exactly_what_is_near(spark, small):
    rng = random.Random(5)
    values = {0}
    for _ in range(60):
        base = rng.choice([rng.getrandbits(64), rng.choice(sorted(values))])
        values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, small)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    want = roots(sorted(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert {n: got.get(n, n) for n in signed} == want


def test_near_duplicates_on_odd_rows(spark):
    same = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(3, same, "x"), (1, same, "y"), (7, None, None), (8, "", "z"), (8, "", "z"), (None, same, "q"), (9, "other words stand in this text here", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["copies"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 1, 3), (1, 1, 3), (3, 1, 3), (7, 7, 3), (8, 7, 3), (8, 7, 3), (9, 9, 1)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 7, 9]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.components(edges).collect()} == {0}


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)

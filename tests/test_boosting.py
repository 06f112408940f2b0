"""Boosted trees against a plain version that grows them leaf by leaf."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopatch.operators import boosting


def tree_plainly(bins, gap, sizes, o):
    """Best-first growth on all rows at once; returns splits in order and the value of each row."""
    worth = lambda rows: int(np.rint(-int(gap[rows].sum()) / (len(rows) + o.l2) * o.rate))

    def best(rows):
        part = lambda g, n: (g / boosting.UNIT) * (g / boosting.UNIT) / (n + o.l2)
        found, g, n = None, int(gap[rows].sum()), len(rows)
        for f, size in enumerate(sizes):
            for b in range(size - 1):
                left = rows[bins[rows, f] <= b]
                if len(left) >= o.least and n - len(left) >= o.least:
                    gl = int(gap[left].sum())
                    gain = part(gl, len(left)) + part(g - gl, n - len(left)) - part(g, n)
                    if found is None or gain > found[0]:
                        found = (gain, f, b)
        return found if found and found[0] > 0 else None

    leaves, splits = [np.arange(len(gap))], []
    while len(leaves) < o.leaves:
        options = [(s, k) for k, rows in enumerate(leaves) if (s := best(rows))]
        if not options:
            break
        (gain, f, b), k = max(options, key=lambda x: x[0][0])
        rows = leaves[k]
        leaves[k : k + 1] = [rows[bins[rows, f] <= b], rows[bins[rows, f] > b]]
        splits.append((f, b, round(gain, 6), len(rows)))
    value = np.zeros(len(gap), np.int64)
    if splits:
        for rows in leaves:
            value[rows] = worth(rows)
    return splits, value


def table(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 40 * np.sin(2 * x[:, 0]) + 25 * (x[:, 1] > 0.3) * x[:, 2] + rng.normal(size=n) * 3
    held = rng.random(n) < 0.25
    rows = [(k, *map(float, x[k]), float(y[k]), bool(held[k])) for k in range(n)]
    return x, y, held, spark.createDataFrame(rows, "id long, a double, b double, c double, y double, held boolean").repartition(3)


EDGES = [np.linspace(-2, 2, 15).tolist(), np.linspace(-1.5, 1.5, 9).tolist(), [-0.5, 0.0, 0.5]]


@pytest.mark.parametrize("leaves", [2, 13])
def test_trees_equal_a_plain_version(spark, monkeypatch, leaves):
    monkeypatch.setattr(boosting, "AHEAD", 3)
    monkeypatch.setattr(boosting, "REWRITE", 2)
    x, y, held, df = table(spark)
    o = boosting.Options(leaves=leaves, rounds=3, least=10, patience=50)
    bag = boosting.random_bag(0.5)
    models = boosting.fit(df, ["a", "b", "c"], "y", "id", [4, 5], o, "held", EDGES, bag)
    bins = boosting.binned(x, [np.array(e) for e in EDGES])
    units = np.rint(y * boosting.UNIT).astype(np.int64)
    base = int(np.floor(units[~held].mean() + 0.5))
    for m in models:
        now, errors = np.full(len(y), base), []
        for number in range(3):
            errors.append(np.sqrt((((now - units)[held] / boosting.UNIT) ** 2).mean()))
            own = ~held & bag(np.arange(len(y)), m.seed, number)
            splits, _ = tree_plainly(bins[own], (now - units)[own], [len(e) + 1 for e in EDGES], o)
            t = m.trees[number]
            assert sorted((f, b, round(g, 6), n) for f, b, g, n in zip(t.feature, t.bin, t.gain, t.rows) if f >= 0) == sorted(splits)
            assert sum(f < 0 for f in t.feature) == len(splits) + 1
            value = np.array(t.value)[t.leaf_of(bins)]
            assert (value[own] == tree_plainly(bins[own], (now - units)[own], [len(e) + 1 for e in EDGES], o)[1]).all()
            now = now + value
        errors.append(np.sqrt((((now - units)[held] / boosting.UNIT) ** 2).mean()))
        assert m.errors == pytest.approx(errors, abs=1e-5)
        assert np.allclose(m.predict(x), now / boosting.UNIT)


def test_early_stop_and_predictions(spark):
    x, y, held, df = table(spark, 600, 3)
    with_nulls = df.unionByName(spark.createDataFrame([(9001, None, 1.0, 1.0, 5.0, False), (9002, 1.0, 1.0, 1.0, None, False), (None, 1.0, 1.0, 1.0, 1.0, True)], df.schema))
    m = boosting.fit(with_nulls, ["a", "b", "c"], "y", "id", [7], boosting.Options(leaves=8, rounds=14, least=10, rate=0.9, patience=3, l2=1.0), "held", EDGES)[0]
    best = int(np.argmin(m.errors))
    assert len(m.trees) == best and (len(m.errors) == 15 or len(m.errors) - 1 - best == 3)
    assert m.errors[best] < np.std(y[held]) / 2
    rows = {r["id"]: r["p"] for r in boosting.predict([m], with_nulls, ["p"]).collect()}
    assert rows[9001] is None and rows[9002] is not None
    assert np.allclose([rows[k] for k in range(len(y))], m.predict(x))
    nodes = boosting.nodes_of(spark, [m])
    gains = {r["feature"]: r["gain"] for r in boosting.importance(nodes, ["a", "b", "c", "d"]).collect()}
    assert gains["d"] == 0 and gains["a"] == pytest.approx(sum(g for t in m.trees for f, g in zip(t.feature, t.gain) if f == 0))
    assert nodes.where("feature is null and n < 10").count() == 0


def test_quantile_bins_and_no_rows(spark):
    _, _, _, df = table(spark, 400, 5)
    m = boosting.fit(df, ["a", "c"], "y", "id", [1], boosting.Options(leaves=6, rounds=2, bins=8))[0]
    assert [len(e) for e in m.edges] == [7, 7] and len(m.trees) == 2
    none = boosting.fit(df.limit(0), ["a"], "y", "id", [1], boosting.Options(rounds=2))[0]
    assert none.trees == [] and none.predict(np.ones((2, 1))).tolist() == [0, 0]
    flat = boosting.fit(df.withColumn("y", F.lit(2.5)), ["a"], "y", "id", [1], boosting.Options(rounds=5))[0]
    assert flat.trees == [] and flat.predict(np.ones((1, 1))).tolist() == [2.5]

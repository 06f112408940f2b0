"""Gradient-boosted regression trees that grow by their best leaf, from histograms of gradients.

Rows are binned once.  A wave of growth is one pass over them: tasks send each
row down the trees so far and add up gradients by seed, leaf, feature and bin;
Spark sums these, and the best split of each leaf comes from running sums over
its bins, so one row a leaf reaches the driver.  All seeds share the passes.
Labels, gradients and leaf values are whole multiples of 1 / UNIT: sums do not
depend on the order of rows, and a task that is run again adds up the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geopatch.sources.scratch import stored

UNIT = 1 << 20
#: Leaves of a tree whose children are looked at in one wave, best first; those not needed in the end are dropped.
AHEAD = 16
#: Rounds after which rows are written again with their predictions, so that later passes need not go down old trees.
REWRITE = 10
#: Whether rows (by key) are in a seed's bag of a round.
Bag = Callable[[np.ndarray, int, int], np.ndarray]


@dataclass(frozen=True)
class Options:
    """Those of the published model."""

    leaves: int = 165
    rate: float = 0.1
    rounds: int = 1000
    least: int = 20
    l2: float = 5.0
    bagging: float = 0.5
    patience: int = 50
    bins: int = 255


@dataclass
class Tree:
    """Nodes by number; a node with feature -1 is a leaf.  Rows with a bin up to ``bin`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def child(self, value: int, rows: int) -> int:
        for column, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.gain, 0.0), (self.rows, rows)):
            column.append(x)
        return len(self.feature) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        feature, split, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        todo = np.flatnonzero(feature[at] >= 0)
        while len(todo):
            node = at[todo]
            at[todo] = np.where(bins[todo, feature[node]] <= split[node], left[node], right[node])
            todo = todo[feature[at[todo]] >= 0]
        return at


@dataclass
class Model:
    """One seed's trees.  ``errors`` are the validation errors after 0, 1, .. rounds, as far as it went."""

    seed: int
    features: list[str]
    edges: list[np.ndarray]
    base: int
    trees: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        total = np.full(len(x), self.base, np.int64)
        for tree in self.trees:
            total += np.array(tree.value)[tree.leaf_of(bins)]
        return total / UNIT


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each value the number of edges below it."""
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.int16).reshape(len(x), len(edges))


def random_bag(share: float) -> Bag:
    """About so many of the rows, by a hash of key, seed and round."""

    def bag(key: np.ndarray, seed: int, number: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * 2**53))

    return bag


def quantile_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of bins of about equal counts, at most ``bins`` - 1 a feature."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], np.float64)) for q in found]


def prepared(rows: DataFrame, features: list[str], label: str, key: str, validation: str | None, edges: list[np.ndarray]) -> DataFrame:
    """``key, y, held, bins`` of the rows without a null in features and label."""
    own = rows.select(F.col(key).cast("long").alias("key"), F.round(F.col(label).cast("double") * UNIT).cast("long").alias("y"), (F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)).alias("held"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    own = own.where(F.col("key").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists(bins)], names=["key", "y", "held", "bins"])

    return own.mapInArrow(run, "key long, y long, held boolean, bins array<short>")


def lists(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Wave:
    """What a pass over the rows needs: for each seed its trees since the rows were written, the tree that grows, and the leaves to look at."""

    def __init__(self, models: list[Model], since: int, growing: dict[int, Tree], wanted: dict[int, list[int]], number: int, sizes: list[int], bag: Bag) -> None:
        self.base, self.since = models[0].base, {k: m.trees[since:] for k, m in enumerate(models)}
        self.growing, self.wanted, self.number, self.bag = growing, wanted, number, bag
        self.seeds = [m.seed for m in models]
        self.offsets = np.r_[0, np.cumsum(sizes)]

    def predicted(self, k: int, held: np.ndarray, bins: np.ndarray) -> np.ndarray:
        total = held[:, k].copy()
        for tree in self.since[k]:
            total += np.array(tree.value)[tree.leaf_of(bins)]
        return total

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``seed, node, feature, bin, g, n`` of a task's rows; node -1 holds squared errors of validation rows in units, high and low part as g, and their count."""
        cells = int(self.offsets[-1])
        g = {k: np.zeros((len(nodes), cells), np.int64) for k, nodes in self.wanted.items()}
        n = {k: np.zeros((len(nodes), cells), np.int64) for k, nodes in self.wanted.items()}
        errors = {k: [0, 0] for k in self.wanted}
        for batch in batches:
            key, y, out = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            bins, held = matrix(batch.column(3), batch.num_rows), matrix(batch.column(4), batch.num_rows)
            place = bins + self.offsets[:-1]
            for k, nodes in self.wanted.items():
                gap = self.predicted(k, held, bins) - y
                if out.any():
                    errors[k][0] += int(np.rint(((gap[out] / UNIT) ** 2).sum() * UNIT))
                    errors[k][1] += int(out.sum())
                own = np.flatnonzero(~out & self.bag(key, self.seeds[k], self.number))
                tree = self.growing[k]
                number = np.full(len(tree.feature), -1)
                number[nodes] = np.arange(len(nodes))
                slot = number[tree.leaf_of(bins[own])]
                own, slot = own[slot >= 0], slot[slot >= 0]
                flat = (slot[:, None] * cells + place[own]).ravel()
                weight = np.repeat(gap[own], place.shape[1])
                g[k] += np.bincount(flat, weight, g[k].size).astype(np.int64).reshape(g[k].shape)
                n[k] += np.bincount(flat, minlength=n[k].size).reshape(n[k].shape)
        for k, nodes in self.wanted.items():
            slot, cell = np.nonzero(n[k])
            feature = np.searchsorted(self.offsets, cell, "right") - 1
            columns = [np.full(len(slot), k), np.array(nodes, np.int64)[slot], feature, cell - self.offsets[feature], g[k][slot, cell], n[k][slot, cell]]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[c, e], t) for c, e, t in zip(columns, (k, -1, 0, 0, *errors[k]), SUMS, strict=True)], names=["seed", "node", "feature", "bin", "g", "n"])


SUMS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def best_splits(sums: DataFrame, l2: float, least: int) -> DataFrame:
    """``seed, node, gain, feature, bin, g_left, n_left, g, n``: the best split of each leaf, of equal ones that of the first feature and bin; gain is null where none is allowed."""
    cells = sums.groupBy("seed", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    own = Window.partitionBy("seed", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.withColumns({"g_left": F.sum("g").over(upto), "n_left": F.sum("n").over(upto), "g": F.sum("g").over(own), "n": F.sum("n").over(own)})
    part = lambda g, n: (g / UNIT) * (g / UNIT) / (n + l2)
    g, n, gl, nl = (F.col(c) for c in ("g", "n", "g_left", "n_left"))
    gain = F.when((nl >= max(1, least)) & (n - nl >= max(1, least)), part(gl, nl) + part(g - gl, n - nl) - part(g, n))
    split = F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "g_left", "n_left", "g", "n")
    best = rows.groupBy("seed", "node").agg(F.max(split).alias("s")).select("seed", "node", "s.*")
    return best.withColumns({"feature": -F.col("feature"), "bin": -F.col("bin")})


def fit(rows: DataFrame, features: list[str], label: str, key: str, seeds: list[int], options: Options | None = None, validation: str | None = None, edges: list[list[float]] | None = None, bag: Bag | None = None) -> list[Model]:
    """One model a seed.  ``validation`` is a boolean column: such rows are not learned from; a seed stops when its error over them has not fallen for ``patience`` rounds, and keeps the trees up to its best round.

    Trees grow best-first: the leaf whose split gains most is split next, until
    there are ``leaves`` of them or none gains.  Rows with null features, label
    or key are left out; without rows a model has no trees.  ``edges`` are the
    upper edges of each feature's bins (quantiles if not given), ``bag`` says
    which rows a round learns from (a share of ``bagging`` if not given).
    """
    options = options or Options()
    bag = bag or random_bag(options.bagging)
    edges = [np.array(e, np.float64) for e in edges] if edges else quantile_edges(rows, features, options.bins)
    table = stored(prepared(rows, features, label, key, validation, edges))
    base = table.where("not held").agg(F.round(F.avg("y")).cast("long")).first()[0] or 0
    models = [Model(s, features, edges, base) for s in seeds]
    held = stored(table.withColumn("held_predictions", F.array_repeat(F.lit(base).cast("long"), len(seeds))))
    active, since = list(range(len(models))), 0
    for number in range(options.rounds + 1):
        growing = {k: Tree() for k in active}
        done = number == options.rounds
        errors = grow(held, models, since, growing, number, options, [len(e) + 1 for e in edges], bag, done)
        for k in active:
            if k in errors:
                models[k].errors.append(errors[k])
            if not done:
                models[k].trees.append(growing[k])
        active = [k for k in active if len(models[k].errors) - 1 - int(np.argmin(models[k].errors or [0])) < options.patience and (done or len(growing[k].feature) > 1)]
        if not active or done:
            break
        if (number + 1) % REWRITE == 0:
            held, since = rewritten(held, models, since), number + 1
    for m in models:
        m.trees = [t for t in m.trees[: int(np.argmin(m.errors)) if m.errors else len(m.trees)] if len(t.feature) > 1]
    return models


def rewritten(held: DataFrame, models: list[Model], since: int) -> DataFrame:
    """The rows with the predictions of all trees so far."""
    wave = Wave(models, since, {}, {}, 0, [], random_bag(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, old = matrix(batch.column(3), batch.num_rows), matrix(batch.column(4), batch.num_rows)
            new = np.stack([wave.predicted(k, old, bins) for k in range(len(models))], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), lists(new)], names=batch.schema.names)

    return stored(held.mapInArrow(run, held.schema))


def grow(held: DataFrame, models: list[Model], since: int, growing: dict[int, Tree], number: int, options: Options, sizes: list[int], bag: Bag, errors_only: bool) -> dict[int, float]:
    """Grows one tree for each seed in ``growing`` and returns the validation errors of the trees before."""
    worth = lambda g, n: int(np.rint(-g / (n + options.l2) * options.rate))
    errors: dict[int, float] = {}
    trial = {k: Tree() for k in growing}
    found: dict[tuple[int, int], dict] = {}
    queue: dict[int, list] = {k: [] for k in growing}
    chosen: dict[int, list[int]] = {k: [] for k in growing}
    wanted = {k: [0] for k in growing}
    while wanted:
        wave = Wave(models, since, trial, wanted, number, sizes, bag)
        sums = held.mapInArrow(wave.sums, "seed int, node int, feature int, bin int, g long, n long")
        for r in best_splits(sums, options.l2, options.least).collect():
            if r["node"] < 0:
                if r["n"]:
                    errors.setdefault(r["seed"], float(np.sqrt(r["g"] / UNIT / r["n"])))
            else:
                found[r["seed"], r["node"]] = r.asDict()
        if errors_only:
            return errors
        wanted = {}
        for k, tree in trial.items():
            seen = lambda node: (k, node) in found and (found[k, node]["gain"] or 0) > 0  # noqa: B023, E731
            if not chosen[k] and not queue[k] and seen(0):
                queue[k] = [(-found[k, 0]["gain"], 0)]
                tree.value[0], tree.rows[0] = worth(found[k, 0]["g"], found[k, 0]["n"]), found[k, 0]["n"]
            while queue[k] and len(chosen[k]) < options.leaves - 1 and tree.feature[queue[k][0][1]] >= 0:
                _, node = heapq.heappop(queue[k])
                chosen[k].append(node)
                for child in (tree.left[node], tree.right[node]):
                    if seen(child):
                        heapq.heappush(queue[k], (-found[k, child]["gain"], child))
            if queue[k] and len(chosen[k]) < options.leaves - 1:
                ahead = [node for _, node in heapq.nsmallest(min(AHEAD, options.leaves - 1 - len(chosen[k])), queue[k]) if tree.feature[node] < 0]
                for node in ahead:
                    s = found[k, node]
                    tree.feature[node], tree.bin[node], tree.gain[node] = s["feature"], s["bin"], s["gain"]
                    tree.left[node] = tree.child(worth(s["g_left"], s["n_left"]), s["n_left"])
                    tree.right[node] = tree.child(worth(s["g"] - s["g_left"], s["n"] - s["n_left"]), s["n"] - s["n_left"])
                wanted[k] = [c for node in ahead for c in (tree.left[node], tree.right[node])]
    for k, tree in trial.items():
        growing[k].__dict__.update(trimmed(tree, set(chosen[k])).__dict__)
    return errors


def trimmed(tree: Tree, chosen: set[int]) -> Tree:
    """The tree with the chosen splits only, in the order of growth from the root."""
    out = Tree()
    out.value[0], out.rows[0] = tree.value[0], tree.rows[0]
    todo = [(0, 0)]
    while todo:
        old, new = todo.pop(0)
        if old in chosen:
            out.feature[new], out.bin[new], out.gain[new] = tree.feature[old], tree.bin[old], tree.gain[old]
            out.left[new] = out.child(tree.value[tree.left[old]], tree.rows[tree.left[old]])
            out.right[new] = out.child(tree.value[tree.right[old]], tree.rows[tree.right[old]])
            todo += [(tree.left[old], out.left[new]), (tree.right[old], out.right[new])]
    return out


def predict(models: list[Model], rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with each model's prediction as a column, in Arrow batches; null where a feature is."""
    features = models[0].features
    given = rows.withColumn("_x", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features]))
    schema = rows.schema
    for name in names:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1), batch.num_rows)
            none = np.isnan(x).any(1)
            made = [pa.array(m.predict(np.nan_to_num(x)), mask=none) for m in models]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *names])

    return given.mapInArrow(run, schema)


def nodes_of(spark: SparkSession, models: list[Model]) -> DataFrame:
    """``seed, round, node, feature, edge, left, right, value, gain, n`` of all nodes, leaves without feature: a model as a table, of at most rounds times leaves times two rows a seed."""
    rows = []
    for m in models:
        for number, t in enumerate(m.trees, 1):
            for node, f in enumerate(t.feature):
                inner = f >= 0
                edge = float(m.edges[f][t.bin[node]]) if inner and t.bin[node] < len(m.edges[f]) else None
                rows.append((m.seed, number, node, m.features[f] if inner else None, edge, t.left[node] if inner else None, t.right[node] if inner else None, t.value[node] / UNIT, float(t.gain[node]) if inner else None, t.rows[node]))
    return spark.createDataFrame(rows, "seed int, round int, node int, feature string, edge double, left int, right int, value double, gain double, n long")


def importance(nodes: DataFrame, features: list[str]) -> DataFrame:
    """``seed, feature, gain``: what the splits on each feature gain in all, 0 for a feature that is not used."""
    seeds = nodes.select("seed").distinct().select("seed", F.explode(F.array(*map(F.lit, features))).alias("feature"))
    gains = nodes.where("feature is not null").groupBy("seed", "feature").agg(F.sum("gain").alias("gain"))
    return seeds.join(gains, ["seed", "feature"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))

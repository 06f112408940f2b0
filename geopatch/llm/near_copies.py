"""Near copies by an exact set-similarity join on five-word shingles.

Two texts are near if the Jaccard similarity of their shingle sets is at least
SIMILARITY.  Candidates come from a prefix filter: when all shingles stand in
one order, two near sets share a shingle among the first of each, as many as
either can miss and one more.  Any order finds every pair; putting the
shingles that many texts hold last keeps the groups that meet small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, settled, sliced, small_batches

#: Words in a shingle, and the least Jaccard similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Cells in which shingles are counted for their order, and of how many texts one is counted; neither changes what is found.
CELLS, ONE_OF = 1 << 16, 8
#: Rows under one key beyond which they are first compared with its earliest row only; how often.
MANY, ROUNDS = 64, 2


def grams(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles; a text with fewer words is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words))], np.uint64)
    runs = zip(*(words[k:] for k in range(shingle)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(g)) for g in runs), np.uint64))


def least_shared(size: int, similarity: float) -> int:
    """Shingles that a set of this size shares with any near one at least."""
    return math.ceil(similarity * size - 1e-9)


def cell_counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of each cell stand in a part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                total += np.bincount((grams(text, shingle) % CELLS).astype(np.int64), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    some = rows.where(F.pmod("k1", F.lit(ONE_OF)) == 0).select("text")
    counts = np.zeros(CELLS, np.int64)
    for r in some.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return counts


def prefixes(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc_id, k1, c1, c2, size, keys`` of every row; c1 and c2 stand for the set, keys are its first shingles."""
    counts, kind = cell_counts(rows, shingle), rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            classes, sizes, keys = [], [], []
            for text in batch.column(2).to_pylist():
                own = grams(text, shingle)
                first = np.lexsort((own, counts[(own % CELLS).astype(np.int64)]))[: len(own) - least_shared(len(own), similarity) + 1]
                classes.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                keys.append(own[first])
            whole = np.frombuffer(b"".join(classes), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int64)])
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["doc_id", "k1", "c1", "c2", "size", "keys"],
            )

    return rows.select("doc_id", "k1", "text").mapInArrow(run, f"doc_id {kind}, k1 long, c1 long, c2 long, size int, keys array<long>")


def sets_of(rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, grams`` of the rows at ``nodes(node)``."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [grams(t, shingle) for t in batch.column(2).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "k1", "grams"])

    asked = rows.join(few(kept(nodes.select("node.doc_id", "node.k1"))), ["doc_id", "k1"], "left_semi").select("doc_id", "k1", "text")
    found = asked.mapInArrow(run, f"doc_id {kind}, k1 long, grams array<long>").dropDuplicates(["doc_id", "k1"])
    return found.select(F.struct("doc_id", "k1").alias("node"), "grams")


def near_of(rows: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node`` of the ``pairs(node, other)`` whose whole sets are near."""
    pairs = kept(pairs)
    sets = kept(sets_of(rows, pairs.select("node").union(pairs.select("other")).distinct(), shingle))
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("grams").alias("other_grams")), "other")
    shared = F.size(F.array_intersect("grams", "other_grams"))
    near = both.where(shared >= similarity * (F.size("grams") + F.size("other_grams") - shared) - 1e-9)
    return kept(near.select("node").distinct())


def later_copies(rows: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node`` of the ``members(key, node, size)`` that are near an earlier one.

    Under keys of more than MANY rows, rows are compared with the first, and
    those not near it with the first of themselves; those found near are not
    compared again, so most of a large group of near copies is settled at one
    or two comparisons a row.  What is left is paired with all earlier rows of
    its keys.  Of two near rows, the one whose first shingles end earlier shares
    with the other those under common keys and others after its own first ones
    only; pairs with too few common keys for that are left out, and the sets of
    the others are compared.
    """
    members = kept(members)
    others = members.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"))
    alike = (F.col("other") < F.col("node")) & (F.least("size", "other_size") >= similarity * F.greatest("size", "other_size") - 1e-9)
    found, large = members.select("node").limit(0), few(kept(members.groupBy("key").count().where(F.col("count") > MANY).select("key")))
    left = members.join(large, "key")
    for _ in range(ROUNDS):
        firsts = left.groupBy("key").agg(F.min(F.struct("node", "size")).alias("head")).select("key", F.col("head.node").alias("other"), F.col("head.size").alias("other_size"))
        left = left.join(few(kept(firsts)), "key").where("node != other")
        new = near_of(rows, left.where(alike).select("node", "other").distinct(), shingle, similarity)
        found = found.union(new)
        left = kept(left.drop("other", "other_size").join(few(new), "node", "left_anti"))
    met = members.join(few(kept(found.distinct())), "node", "left_anti").join(others, "key").where(alike)
    counted = met.groupBy("node", "other").agg(F.count("*").alias("common"), F.max("size").alias("size"), F.max("other_size").alias("other_size"))
    after = F.ceil(similarity * F.greatest("size", "other_size") - 1e-9) - 1
    needed = similarity / (1 + similarity) * (F.col("size") + F.col("other_size")) - 1e-9
    return found.union(near_of(rows, counted.where(F.col("common") + after >= needed).select("node", "other"), shingle, similarity))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, without: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are no near copy of an earlier row.

    The order is by id; between rows of one id it is by a hash of the text.  Of
    two rows at a Jaccard similarity of at least ``similarity`` the later one
    goes, whether or not the earlier one stays, so no two of those left are
    near.  Of rows with the same shingles, or with no words, the first stays.
    Rows with a null id all stay and take no part.  The rows at
    ``without(doc_id, k1)``, where k1 is the XXH64 of the text, go first and
    take no part either; it is read more than once.  Columns are those of
    ``docs``.

    Of the rows that meet under a key, one a class of equal sets, the keys are
    shuffled once; no copy of the texts is written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("k1"), text.alias("text"))
    with settled(spark):
        firsts = prefixes(rows, shingle, similarity)
        table = kept(firsts if without is None else firsts.join(few(without), ["doc_id", "k1"], "left_anti"))
        repeated = not table.groupBy("doc_id", "k1").count().where("count > 1").isEmpty()
        classes = kept(table.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "k1")).alias("node"), F.max("size").alias("size")))
        copies = kept(table.select(F.struct("doc_id", "k1").alias("node")).join(classes, "node", "left_anti").distinct())
        own = table.select(F.struct("doc_id", "k1").alias("node"), "c1", "keys").join(few(copies), "node", "left_anti")
        same = Window.partitionBy("key")
        every = own.select(F.explode("keys").alias("key"), "c1").select("key", "c1", F.min("c1").over(same).alias("least"), F.max("c1").over(same).alias("most"))
        members = every.where("least < most").select("key", "c1").distinct().join(classes, "c1").select("key", "node", "size")
        found = copies.union(later_copies(rows, members, shingle, similarity)).select("node.doc_id", "node.k1")
        gone = kept((found if without is None else found.union(without.select("doc_id", "k1"))).distinct())
    gone = few(gone.select(F.col("doc_id").alias("own_id"), F.col("k1").alias("own_k1")))
    hashed = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("doc"), F.xxhash64(text).alias("own_hash"))
    once = hashed.join(gone, (F.col("doc.doc_id") == gone["own_id"]) & (hashed["own_hash"] == gone["own_k1"]), "left_anti")
    if repeated:
        once = once.withColumn("own_id", F.col("doc.doc_id")).dropDuplicates(["own_id", "own_hash"])
    return once.select("doc.*").unionByName(docs.where("doc_id is null"))

"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles.
The candidate search uses a covering family: every bit position gets a nonzero
vector of GF(2)^(radius+1), and every nonzero vector v of that space gives one
mask that keeps the positions whose vector is not orthogonal to v.  At most
``radius`` differing positions span a proper subspace, so some v is orthogonal
to all of them and the pair agrees under that mask: recall is exactly 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import cut, few, kept, settled, source
from geopatch.llm.components import components

BITS = 64
#: Shingles whose bits are spread out at once; bounds a worker's memory.
BLOCK = 1 << 15


def majority(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), seed)
    total, ones = len(words) - shingle + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        block = words[at : min(at + BLOCK, total) + shingle - 1]
        grams = zip(*(block[k:] for k in range(shingle)), strict=False)
        values = np.fromiter((digest(b" ".join(g), seed) for g in grams), np.uint64)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row; fp is the fingerprint as a signed long.

    Words are runs of non-blank bytes after lower-casing A-Z.  A text with
    fewer words than ``shingle`` counts as one shingle; null, empty and blank
    texts have fingerprint 0.  Repeated rows give repeated results.
    """
    rows = source(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((majority(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks of the covering family, as signed 64-bit integers."""
    dims = (1 << (radius + 1)) - 1
    vectors = [1 + i % dims for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, dims + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2, small: int = 64) -> DataFrame:
    """Edges ``a, b`` that connect exactly the distinct values of ``fps(fp)`` within ``radius``.

    Every two values within the radius are connected, directly or through
    values that are themselves within the radius of each other.  Values that
    share a masked bucket of at most ``small`` members are compared pairwise.
    Members of larger buckets are joined through hubs instead of pairs: each
    emits the values at distance up to radius/2, and two values share such a
    hub if and only if they are within the radius, so the work stays linear in
    the bucket and nothing is lost or added.  ``radius`` must be even.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(covering_masks(radius))])
    hashed = fps.select("fp", F.inline(tables))
    sizes = hashed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(hashed.join(sizes, ["k", "key"]))
    few, many = shared.where(F.col("n") <= small), shared.where(F.col("n") > small).select("fp").distinct()
    near = (
        few.select("k", "key", F.col("fp").alias("a"))
        .join(few.select("k", "key", F.col("fp").alias("b")), ["k", "key"])
        .where(F.expr(f"a < b and bit_count(a ^ b) <= {radius}"))
        .select("a", "b")
    )
    ball = F.array(F.col("fp"))
    for _ in range(radius // 2):
        ball = F.array_distinct(F.concat(ball, F.flatten(F.transform(ball, lambda x: F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))))))
    hubs = many.select("fp", F.explode(ball).alias("hub"))
    heads = hubs.groupBy("hub").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).where("head < last").drop("last")
    starred = hubs.join(heads, "hub").where("fp != head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return near.union(starred).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id, copies`` for every row of ``docs``.

    component_id is the smallest id reachable over links of at most ``radius``
    differing bits; copies is the number of rows in the component.  Equal
    fingerprints are one node of the graph, so groups of exact copies of any
    size cost one row.  Rows with a null id take part; a component of null ids
    only has a null component_id.  An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("copies"))
    named = kept(rooted.select("fp", "root").join(classes, "root").drop("root"))
    return rows.join(few(named), "fp").select("doc_id", "fp", "component_id", "copies")


def later(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, k1`` of the rows of ``docs`` that are not the first of their component; k1 is a hash of the text.

    The order is by id; between rows of one id it is by k1.  Rows with a null
    id take no part.
    """
    node = F.struct(docs[id_col].alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("k1"))
    own = docs.where(docs[id_col].isNotNull()).select(node.alias("node"), docs[text_col].alias("text"))
    with settled(docs.sparkSession):
        found = near_duplicates(own, "node", "text", shingle, radius)
        return kept(found.where("doc_id != component_id").select("doc_id.*").distinct())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the first row stays.

    The order is by id; between rows of one id it is by a hash of the text.  Of
    repeated rows one stays; rows with a null id all stay and take no part.
    Columns are those of ``docs``.
    """
    of = lambda c: F.col(f"doc.`{c}`")
    own = docs.where(docs[id_col].isNotNull()).select(F.struct(*docs.columns).alias("doc"))
    own = own.withColumn("node", F.struct(of(id_col).alias("doc_id"), F.xxhash64(F.coalesce(of(text_col), F.lit(""))).alias("k1")))
    gone = later(docs, id_col, text_col, shingle, radius).select(F.struct("doc_id", "k1").alias("node"))
    once = own.join(few(gone), "node", "left_anti")
    if not own.groupBy("node").count().where("count > 1").isEmpty():
        once = once.dropDuplicates(["node"])
    return once.select("doc.*").unionByName(docs.where(docs[id_col].isNull()))

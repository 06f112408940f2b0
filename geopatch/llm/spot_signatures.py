"""Document fingerprints from spot signatures.

A signature is an anchor (a very common word) with the next content words after
it; a fingerprint is the set of a text's signatures.  Everything is built from
DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopatch.llm.common import cut, sha256_of, source

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from had has have he her his if in is it not of on or that the there they this to was were which with you "
    "als auf aus bei das dem den der des die ein eine für im ist mit nicht sich sie und von war wie zu zum zur "
    "au avec ce dans de des du elle en est et il la le les ne pas pour que qui sa se son sur un une "
    "al con del el ella era es esta ha las lo los no para por su sus y"
).split()
#: One word in so many stands in as an anchor.
STAND_IN = 8
#: Content words in a chain.
CHAIN = 2
#: Bits of an id within its block; bits of what one window of ids orders.
BLOCK_BITS, LEVEL_BITS = 8, 16
#: Rows of two longs up to which the first documents of blocks are broadcast (16 MB); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def signatures(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds the fingerprint of a text column: a sorted array of distinct 32-bit signatures.

    Anchors are the common words and, for texts that have few of them (tables,
    other languages), the words whose hash is divisible by STAND_IN.  Each
    anchor gives one signature, of the anchor and the next CHAIN content
    words after it (fewer at the end of a text, none after the last content
    word).  Words are runs of letters and digits in lower case.  Null and empty
    texts and texts without anchors have an empty set.
    """
    words, content = f"{name}_words", f"{name}_content"
    rows = rows.withColumn(words, F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    places = F.filter(F.transform(words, lambda w, i: F.when(~w.isin(ANCHORS) & (F.pmod(F.hash(w), F.lit(STAND_IN)) != 0), i)), lambda i: i.isNotNull())
    rows = rows.withColumn(content, places)
    at = lambda j: F.get(F.col(content), j)
    word = lambda i: F.get(F.col(words), i)

    def of(place: Column, j: Column) -> Column:
        before = F.coalesce(at(j - 1), F.lit(-1))
        chain = [word(at(j + k)) for k in range(1, CHAIN)]
        return F.transform(F.slice(words, before + 2, place - before - 1), lambda anchor: F.hash(anchor, word(place), *chain))

    return rows.withColumn(name, F.array_sort(F.array_distinct(F.flatten(F.transform(content, of))))).drop(words, content)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two signature sets; two empty sets are alike only if both are empty (1).

    Sets without a common size class cannot meet: an empty set and another have
    likeness 0 without a comparison.
    """
    both = F.size(F.array_intersect(a, b))
    sizes = F.size(a) + F.size(b)
    return F.when(sizes == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (sizes - both))


def successors(keys: DataFrame) -> DataFrame:
    """``key, next`` of distinct long keys: the next greater one, null for the last.

    Up to 2^LEVEL_BITS keys are ordered in one window.  More are ordered within
    blocks of consecutive values, and the blocks among themselves in the same
    way, so that no window holds more rows than that, however the keys are
    spread.
    """
    keys = cut(keys)
    if keys.count() <= 1 << LEVEL_BITS:
        return keys.selectExpr("key", "lead(key) over (order by key) as next")
    rows = keys.selectExpr("key", f"shiftright(key, {LEVEL_BITS}) as block").selectExpr("key", "block", "lead(key) over (partition by block order by key) as follows")
    heads = cut(rows.groupBy("block").agg(F.min("key").alias("head")))
    later = successors(heads.select(F.col("block").alias("key"))).select(F.col("key").alias("block"), F.col("next").alias("later"))
    onward = later.join(heads.select(F.col("block").alias("later"), "head"), "later").select("block", "head")
    return rows.join(onward, "block", "left").select("key", F.coalesce("follows", "head").alias("next"))


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, sigs, next_text, next_sigs``: every row with the document that follows by ascending id.

    The last document is followed by the first; a single one follows itself.
    Of repeated rows with one id, the one with the least text counts as the
    next document.  Rows with a null id, or one that is no whole number, have
    the empty text as their next.
    Rows are placed by blocks of ids in one shuffle of the texts, and the first
    document of every block also goes to the block before it.
    """
    rows = source(docs, id_col, text_col).withColumn("id", F.col("doc_id").try_cast("long"))
    placed = rows.where("id is not null").withColumn("block", F.shiftright("id", BLOCK_BITS))
    blocks = cut(placed.groupBy("block").agg(F.min("id").alias("id")))
    order = successors(blocks.select(F.col("block").alias("key")))
    first = blocks.agg(F.min("block").alias("first"))
    onward = order.crossJoin(F.broadcast(first)).select(F.col("key").alias("into"), F.coalesce("next", "first").alias("block"))
    borders = cut(onward.join(blocks, "block").select("id", "into"))
    if borders.count() <= BROADCAST_ROWS:
        borders = F.broadcast(borders)
    lead = rows.join(borders, "id").select("doc_id", "text", "id", F.col("into").alias("block"), F.lit(1).alias("border"))
    both = signatures(placed.withColumn("border", F.lit(0)).unionByName(lead), "text", "sigs")
    backward = Window.partitionBy("block").orderBy(F.desc("border"), F.desc("id"), F.desc("text"))
    before = lambda c: F.lag(c).over(backward)
    fresh = (before("border") != F.col("border")) | (before("id") != F.col("id"))
    seen = both.withColumn("own", F.when(fresh, F.struct(before("text").alias("text"), before("sigs").alias("sigs"))))
    seen = seen.withColumn("after", F.last("own", ignorenulls=True).over(backward)).where("border = 0")
    alone = signatures(rows.where("id is null"), "text", "sigs").select("doc_id", "text", "sigs", F.lit("").alias("next_text"), F.array().cast("array<int>").alias("next_sigs"))
    return seen.select("doc_id", "text", "sigs", F.col("after.text").alias("next_text"), F.col("after.sigs").alias("next_sigs")).unionByName(alone)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text has its last quarter of code points (rounded down) replaced
    by as many from the start of the next document, or all it has.  A
    fingerprint is written as its sorted signatures, joined by commas.  Null
    texts are empty; an empty text has an empty fingerprint.
    """
    rows = chained(docs).withColumn("n_chars", F.length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - part).cast("int")), F.substring("next_text", F.lit(1), part))
    rows = signatures(rows.withColumn("edited", edited), "edited", "edited_sigs")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        "n_chars",
        sha256_of(F.col("edited")).alias("edited_sha256"),
        joined("sigs").alias("fingerprint"),
        joined("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"),
        likeness("sigs", "next_sigs").alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, likeness`` of all pairs of different fingerprints with at least the threshold.

    a < b are the least ids that have the two fingerprints; copies are reached
    through ``classes``.  Fingerprints are partitioned by the logarithm of
    their size, so that only neighbouring partitions can reach the threshold.
    Candidates share one of the globally rarest signatures of each, as many as
    the threshold leaves room to miss, and are pruned by size before the
    sets are compared.  Empty fingerprints have no pairs.
    """
    sets = cut(classes(docs, id_col, text_col).groupBy("sigs").agg(F.min("class_id").alias("id")).where(F.size("sigs") > 0))
    each = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "sig"))
    rare = each.join(common, "sig").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    level = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    rare = cut(rare.select("id", "n", "sig", level.alias("level")))
    right = rare.select(F.col("id").alias("b"), F.col("n").alias("m"), "sig", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"))
    pairs = rare.withColumnRenamed("id", "a").join(right, ["sig", "level"]).where(F.expr(f"a < b and least(n, m) >= {threshold} * greatest(n, m)")).select("a", "b").distinct()
    named = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("right")), "b")
    return named.select("a", "b", likeness("left", "right").alias("likeness")).where(F.col("likeness") >= threshold)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sigs, class_id`` of every row: class_id is the least id with the same fingerprint."""
    rows = signatures(source(docs, id_col, text_col), "text", "sigs").select("doc_id", "sigs")
    return rows.join(rows.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "sigs")

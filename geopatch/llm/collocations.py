"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

Tasks build stripes from whole texts: a word's stripe counts the words that
follow it and, under the empty word, the pieces it ends, so its total is the
word's own count.  Merged element by element, they give pairs and totals.  Second
stripes count the two words that follow a word, where both pairs are frequent;
they give phrases of three words and, by the largest entry, what subsumes a
pair.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, sliced, small_batches

#: Separators of pieces become BREAK, a byte that UTF-8 has not; bytes.lower() lowers A-Z alone.
BREAK = b"\xff"
SEPARATE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")
#: Occurrences of words that a task puts into stripes at a time.
TOKENS = 4_000_000
#: Bytes of a text that are split into words at a time, up to the next end of a piece.
SEGMENT = 4_000_000
#: Bits of the filter of frequent pairs, whatever the input; where it fills up, more pairs are counted for nothing.
FILTER_BITS = 1 << 26
#: A prefix with over this share of all words is merged entry by entry, so at most so many prefixes are.
HOT_SHARES = 4096
HOT_LEAST = 16_384
STRIPE = "lang string, prefix string, total long, next array<string>, count array<long>"
#: Parts into which a task's second stripes of a language are dealt, by a hash of the prefix, or of the phrase if the prefix is hot; a row holds the stripes of one part.
PARTS = 256
PACKED = "lang string, part int, prefix array<string>, next array<array<string>>, count array<array<long>>"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, with BREAK after each piece, in parts that end with a piece."""
    text = text.lower().translate(SEPARATE)
    at = 0
    while at < len(text):
        end = text.find(BREAK, at + SEGMENT)
        end = len(text) if end < 0 else end
        yield [*text[at:end].replace(BREAK, b" \xff ").split(), BREAK]
        at = end


class Tokens:
    """Numbers of words, in order, of one language; 0 is the end of a piece."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[BREAK]  # noqa: B018
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.size += len(words)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """``lang, numbers, words by number`` of up to about TOKENS words at a time from batches of ``lang, text``."""
    held: dict[str, Tokens] = defaultdict(Tokens)
    for batch in sliced(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for words in words_of(text.as_py()):
                held[lang].add(words)
                if sum(t.size for t in held.values()) > TOKENS:
                    for one, t in held.items():
                        yield one, np.concatenate(t.parts), list(t.number)
                    held.clear()
    for one, t in held.items():
        yield one, np.concatenate(t.parts), list(t.number)


def as_stripes(lang: str, prefixes: pa.Array, prefix: np.ndarray, follower: np.ndarray, count: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Stripes from entries in the order of their prefix, some hundred thousand entries a batch."""
    starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(prefix) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(prefix)]
    totals = np.add.reduceat(count, starts) if len(starts) else starts
    edge = [0, *(np.flatnonzero(np.diff(starts // 200_000)) + 1).tolist(), len(starts)]
    for a, b in itertools.pairwise(edge):
        if a < b:
            low, high = starts[a], ends[b - 1]
            offsets = pa.array(np.r_[starts[a:b], high] - low, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (b - a), pa.string()),
                    prefixes.take(pa.array(prefix[starts[a:b]])),
                    pa.array(totals[a:b], pa.int64()),
                    pa.ListArray.from_arrays(offsets, words.take(pa.array(follower[low:high]))),
                    pa.ListArray.from_arrays(offsets, pa.array(count[low:high], pa.int64())),
                ],
                names=["lang", "prefix", "total", "next", "count"],
            )


def word_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of single words."""
    for lang, ids, words in chunks(batches):
        at = np.flatnonzero(ids[:-1])
        code, count = np.unique(ids[at] << 32 | ids[at + 1], return_counts=True)
        names = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())
        yield from as_stripes(lang, names, code >> 32, code & 0xFFFFFFFF, count, names)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def places(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a pair of words with these hashes."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x7F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mask = np.uint64(bits - 1)
    return mixed & mask, (mixed >> np.uint64(32)) & mask


def pair_filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``pairs(lang, prefix, next)`` as 64-bit words: at most ``bits`` bits come to the driver, whatever the number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, one, two = (batch.column(k).to_pylist() for k in range(3))
            seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(lang)}
            hashed = [np.fromiter((xxhash.xxh64_intdigest(w, seeds[x]) for x, w in zip(lang, ws, strict=True)), np.uint64, len(ws)) for ws in (one, two)]
            at = np.concatenate(places(*hashed, bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    found = pairs.select("lang", "prefix", "next").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def packed_stripes(lang: str, prefixes: pa.Array, prefix: np.ndarray, follower: np.ndarray, count: np.ndarray, part: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Stripes of entries, one row a part: its prefixes, and each one's followers and counts.  So rows are at most PARTS a chunk, however many prefixes it has."""
    order = np.lexsort((prefix, part))
    prefix, follower, count, part = prefix[order], follower[order], count[order], part[order]
    starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])]) if len(prefix) else np.zeros(0, np.int64)
    rows = np.flatnonzero(np.r_[True, np.diff(part[starts]) != 0]) if len(starts) else starts
    ends, row_ends = np.r_[starts, len(prefix)], np.r_[rows, len(starts)]
    for a in range(0, len(rows), 32):
        b = min(a + 32, len(rows))
        lists = starts[rows[a] : row_ends[b]]
        low, high = lists[0], ends[row_ends[b]]
        inner, outer = pa.array(np.r_[lists, high] - low, pa.int32()), pa.array(row_ends[a : b + 1] - rows[a], pa.int32())
        nested = [pa.ListArray.from_arrays(inner, values) for values in (words.take(pa.array(follower[low:high])), pa.array(count[low:high], pa.int64()))]
        own = [prefixes.take(pa.array(prefix[lists])), *nested]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (b - a), pa.string()), pa.array(part[starts[rows[a:b]]], pa.int32()), *[pa.ListArray.from_arrays(outer, x) for x in own]], names=["lang", "part", "prefix", "next", "count"])


def pair_stripes(known: Callable[[], np.ndarray], bits: int, hot: dict[str, set[bytes]] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stripes of the pairs of words that follow a word, for places where both the pair and the one that begins a word later pass the filter, packed by part.

    A prefix lies in one part of all tasks, unless it is ``hot`` in its language: then its phrases are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known = known()

        def may_be(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            ok = np.ones(len(first), bool)
            for at in places(first, second, bits):
                ok &= (words_known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            return ok

        for lang, ids, words in chunks(batches):
            hashes = word_hashes(lang, words)
            pair = np.zeros(len(ids), bool)
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            pair[at] = may_be(hashes[ids[at]], hashes[ids[at + 1]])
            at = np.flatnonzero(pair[:-1] & pair[1:])
            pairs, number = np.unique(ids[at + 1] << 32 | ids[at + 2], return_inverse=True)
            code, count = np.unique(ids[at] << 32 | number, return_counts=True)
            names = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())
            joined = pa.array([words[p >> 32] + b" " + words[p & 0xFFFFFFFF] for p in pairs.tolist()], pa.binary()).cast(pa.string())
            first, second = code >> 32, code & 0xFFFFFFFF
            often = (hot or {}).get(lang, set())
            is_hot = np.fromiter((w in often for w in words), bool, len(words))
            # a follower's two hashes, mixed; those of a prefix that is not hot do not count
            follower = hashes[pairs >> 32] * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs & 0xFFFFFFFF]
            mixed = hashes[first] ^ np.where(is_hot[first], follower[second], np.uint64(0))
            yield from packed_stripes(lang, names, first, second, count, ((mixed >> np.uint64(32)) % np.uint64(PARTS)).astype(np.int32), joined)

    return run


def unpacked(stripes: DataFrame) -> DataFrame:
    """``lang, prefix, next, n``: the packed stripes of each part added up element by element.  A phrase lies in one part."""
    dealt = stripes.repartition("lang", "part")
    each = dealt.select("lang", "part", F.inline(F.arrays_zip("prefix", "next", "count"))).select("lang", "part", "prefix", F.inline(F.arrays_zip("next", "count")))
    return each.groupBy("lang", "part", "prefix", "next").agg(F.sum("count").alias("n")).drop("part")


def merged(stripes: DataFrame, totals: DataFrame, hot: float) -> DataFrame:
    """``lang, prefix, next, n``: stripes added up element by element.

    A stripe goes to its prefix's task as one row.  Prefixes with a total
    (``totals(lang, prefix, f)``) over ``hot`` are few, as ``hot`` is a share
    of all words; their entries are dealt out by the next word instead.
    """
    keys = ["lang", "prefix"]
    many = F.broadcast(totals.where(F.col("f") > hot).select(*keys))
    entries = lambda rows: rows.select(*keys, F.inline(F.arrays_zip("next", "count"))).groupBy(*keys, "next").agg(F.sum("count").alias("n"))
    whole = stripes.select(*keys, "next", "count").join(many, keys, "left_anti").repartition(*keys)
    return entries(whole).unionByName(entries(stripes.join(many, keys, "left_semi")))


def quotient(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (left right)), exactly."""
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * {whole(a)} * {whole(a)}) div ({whole(left)} * {whole(right)}) as long)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two or three words of each language.

    Texts are lowered in A-Z and split into pieces at ``.,;:!?`` and line
    breaks, pieces into words at blanks and tabs.  a is how often a phrase
    stands within pieces, at least ``least``; l and r are how often the parts
    of its lowest-scoring cut do (of equal scores the first cut), n is the
    number of all words.  A phrase is left out if ``share`` percent of its
    places lie in one longer candidate.  Ranks go by score and a, descending,
    then by phrase.  Null texts have no words, a null language is ``und``;
    repeated rows count as often as they stand.  A language without candidates
    has no rows.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text")).where("text is not null")
    stripes = kept(rows.mapInArrow(word_stripes, STRIPE))
    words = kept(stripes.groupBy("lang", "prefix").agg(F.sum("total").alias("f")).where(F.col("f") >= least))
    sizes = kept(stripes.groupBy("lang").agg(F.sum("total").alias("n")))
    hot = max(HOT_LEAST, (sizes.agg(F.sum("n")).first()[0] or 0) / HOT_SHARES)
    pairs = kept(merged(stripes, words, hot).where((F.col("next") != "") & (F.col("n") >= least)))
    shared = spark.sparkContext.broadcast(pair_filter(pairs, FILTER_BITS))
    many: dict[str, set[bytes]] = defaultdict(set)
    for r in words.where(F.col("f") > hot).select("lang", "prefix").collect():  # at most HOT_SHARES
        many[r["lang"]].add(r["prefix"].encode("utf-8", "surrogatepass"))
    triples = kept(unpacked(rows.mapInArrow(pair_stripes(lambda: shared.value, FILTER_BITS, dict(many)), PACKED)).where(F.col("n") >= least))
    shared.unpersist()
    best = kept(scored(words, pairs, triples, share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    first = best.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top).drop("place")
    ranked = first.withColumn("rank", rank).where(F.col("rank") <= top).join(few(sizes), "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame, share: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates that no longer candidate subsumes."""
    at = lambda name, frame, key, value: few(kept(frame.select("lang", F.col(key).alias(name), F.col(value).alias(f"f_{name}"))))
    phrase = F.concat_ws(" ", "prefix", "next")
    two = pairs.select("lang", "prefix", "next", phrase.alias("phrase"), F.col("n").alias("a"))
    pair = F.concat_ws(" ", "prefix", F.substring_index("next", " ", 1))
    three = triples.select("lang", F.col("prefix").alias("one"), pair.alias("prefix"), F.col("next").alias("rest"), F.substring_index("next", " ", -1).alias("next"), phrase.alias("phrase"), F.col("n").alias("a"))
    longest = three.select("lang", F.explode(F.array("prefix", "rest")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = two.join(few(kept(longest)), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    two = two.join(at("prefix", words, "prefix", "f"), ["lang", "prefix"]).join(at("next", words, "prefix", "f"), ["lang", "next"])
    two = two.withColumnsRenamed({"f_prefix": "l", "f_next": "r"}).withColumn("score", quotient("a", "l", "r")).select("lang", "phrase", "a", "l", "r", "score")
    both = pairs.select("lang", phrase.alias("pair"), "n")
    three = three.join(at("one", words, "prefix", "f"), ["lang", "one"]).join(at("next", words, "prefix", "f"), ["lang", "next"])
    three = three.join(at("prefix", both, "pair", "n"), ["lang", "prefix"]).join(at("rest", both, "pair", "n"), ["lang", "rest"])
    cut = lambda k, left, right: F.struct(quotient("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    three = three.withColumn("cut", F.least(cut(1, "f_one", "f_rest"), cut(2, "f_prefix", "f_next")))
    return two.unionByName(three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))

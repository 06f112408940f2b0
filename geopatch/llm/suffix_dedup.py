"""Removal of repeated passages by suffix sorting.

A passage is a run of bytes of a fixed length.  The suffix arrays are built in
tasks, over the stretches of text that can hold a repeat.  These are found by
anchors: the least hash among the grams inside a passage, which is the same
wherever the passage stands.  All passages with one anchor are compared with
each other, and passages whose anchor stands once are not repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import kept, row_key, source

#: Bytes in a passage, and in the grams whose hashes are anchors.
PASSAGE, GRAM = 200, 32
#: Starts of passages handled at once; bounds the memory of a task.
BLOCK = 1 << 20
#: Bytes of stretches that one suffix array covers, if their anchors allow.
BATCH = 1 << 20
#: Different stretches of one anchor up to which a suffix array compares them (some 5 MB); beyond, the passages' hashes are counted.
HOT = 1 << 14
#: Suffixes whose first bytes are laid out for sorting at once.
LAID_OUT = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place."""
    n = len(data) - gram + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, len(data)), dtype=np.uint64)])
    out = (sums[gram:] - sums[:n]) * powers(BASE, n)
    for shift in (np.uint64(32), np.uint64(29)):
        out ^= out >> shift
        out *= MIX
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """A hash of each data[start:end]."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(np.uint64(pow(base, -1, 1 << 64)), len(data)), dtype=np.uint64)])
    out = (sums[ends] - sums[starts]) * powers(np.uint64(base), len(data))[starts]
    return (out ^ (out >> np.uint64(31))) * MIX


def anchors(data: np.ndarray, passage: int = PASSAGE, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each run of passages with one anchor, block by block: the anchor's hash, a hash of the stretch they cover, the first start and the end (exclusive) of the starts."""
    for at in range(0, len(data) - passage + 1, BLOCK):
        own = data[at : at + BLOCK + passage - 1]
        hashes = gram_hashes(own, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_min((hashes & ~np.uint64(0xFFFFFF)) | place, passage - gram + 1) & np.uint64(0xFFFFFF)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least))
        view = memoryview(own)
        stretch = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(first.tolist(), (last + passage - 1).tolist(), strict=True)), np.uint64, len(first))
        yield hashes[least[first].astype(np.int64)], stretch, first + at, last + at


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one after it; data ends in its least value."""
    step = np.sign(np.diff(data.astype(np.int16), append=0))
    step[-1] = -1
    known = np.where(step != 0, np.arange(len(step)), len(step))
    return step[np.minimum.accumulate(known[::-1])[::-1]] > 0


def sorted_directly(data: np.ndarray, places: np.ndarray, depth: int) -> list[np.ndarray]:
    """The places by first byte, each list in the order of the first ``depth`` bytes from there."""
    rows = np.lib.stride_tricks.sliding_window_view(data, depth)
    pair = (data[places].astype(np.uint16) << 8) | data[places + 1]
    places = places[np.argsort(pair, kind="stable")]
    pair = np.sort(pair, kind="stable")
    out: list[list[np.ndarray]] = [[] for _ in range(256)]
    for own in np.split(places, np.flatnonzero(np.diff(pair)) + 1) if len(places) else []:
        at = 2
        todo = [own]
        while max(map(len, todo)) > LAID_OUT and at < depth:
            finer = []
            for part in todo:
                byte = data[part + at]
                order = np.argsort(byte, kind="stable")
                finer += np.split(part[order], np.flatnonzero(np.diff(byte[order])) + 1)
            todo, at = finer, at + 1
        for part in todo:
            if len(part) > 1 and at < depth:
                part = part[np.argsort(rows[part].view(f"S{depth}").reshape(-1), kind="stable")]
            out[data[part[0]]].append(part)
    return [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places by the order of the first ``depth`` bytes from there, by two-stage sorting.

    ``data`` ends in ``depth`` zeros.  Only suffixes that are smaller than
    their successors are sorted directly.  The others follow from them: reading
    the buckets of first bytes in order, each suffix puts the one that starts a
    byte before it, if that is larger, at the end of what its own bucket holds
    so far.
    """
    small = smaller_than_next(data)
    needed = wanted.copy()
    following = np.where(small, np.arange(len(data)), len(data))
    following = np.minimum.accumulate(following[::-1])[::-1]
    at = np.flatnonzero(wanted & ~small)
    ends = np.minimum(following[at], len(data) - 1)
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, ends + 1, -1)
    needed |= np.cumsum(marks[:-1]) > 0
    large = needed & ~small
    direct = sorted_directly(data, np.flatnonzero(needed & small & (np.arange(len(data)) <= len(data) - depth)), depth)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = np.array([len(data) - 1]) if large[-1] else np.zeros(0, np.int64)
    waiting[int(data[-1])].append(last)
    order = []
    for value in range(256):
        for turn in (waiting[value], [direct[value]]):
            k = 0
            while k < len(turn):
                own = turn[k]
                k += 1
                order.append(own)
                before = own[own > 0] - 1
                before = before[large[before]]
                if len(before):
                    byte = data[before]
                    sort = np.argsort(byte, kind="stable")
                    before, byte = before[sort], byte[sort]
                    for part in np.split(before, np.flatnonzero(np.diff(byte)) + 1):
                        waiting[int(data[part[0]])].append(part)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated(texts: list[bytes], passage: int = PASSAGE) -> list[np.ndarray]:
    """Of each text, whether the passage from each start stands elsewhere in the texts too."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0" * (passage + 1), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    starts = np.maximum(sizes - passage + 1, 0)
    wanted = np.zeros(len(data), bool)
    for b, n in zip(begin.tolist(), starts.tolist(), strict=True):
        wanted[b : b + n] = True
    order = suffix_order(data, wanted, passage)
    alike = common_prefix(data, order[:-1], order[1:], passage)
    found = np.zeros(len(data), bool)
    found[order[:-1][alike]] = True
    found[order[1:][alike]] = True
    return [found[b : b + n] for b, n in zip(begin.tolist(), starts.tolist(), strict=True)]


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether neighbours in the order have the first ``length`` bytes in common."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    alive = np.arange(len(a))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x, y = (np.ascontiguousarray(words[p[alive] + at]).view(np.uint64).reshape(-1) for p in (a, b))
        alive = alive[x == y]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"s": int(s), "e": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)]


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def anchor_table(rows: DataFrame) -> DataFrame:
    """``k1, k2, h, c, a, b``: anchor, stretch and starts of each run of passages of ``rows(k1, k2, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                for h, c, a, b in anchors(np.frombuffer(text.as_buffer(), np.uint8)):
                    at = pa.array(np.full(len(h), i, np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["k1", "k2", "h", "c", "a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in run(batches):
            held.append(part)
            size += part.num_rows
            if size >= 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.select("k1", "k2", "text").mapInArrow(joined, "k1 long, k2 long, h long, c long, a int, b int")


def stretches(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``h, c, single, bytes`` of the stretches at ``asked(h, c, single, k1, k2, a, b)``."""
    wanted = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "single", "a", "b")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1), strict=True):
                data, own = text.as_buffer().to_pybytes(), own.values
                a, b = own.field("a").to_pylist(), own.field("b").to_pylist()
                part = [data[x : y + PASSAGE - 1] for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([own.field("h"), own.field("c"), own.field("single"), pa.array(part, pa.binary())], names=["h", "c", "single", "bytes"])

    return rows.join(wanted, ["k1", "k2"]).select("text", "asked").mapInArrow(run, "h long, c long, single boolean, bytes binary")


def by_suffixes(parts: DataFrame) -> DataFrame:
    """``h, c, spans``: the starts of repeated passages in stretches ``parts(h, c, single, bytes)``, by suffix arrays over whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[bytes, bool]] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            flags = repeated([x[0] for x in held.values()])
            out = [(k, runs(f)) for (k, (_, single)), f in zip(held.items(), flags, strict=True) if single and f.any()]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in out], pa.int64()), pa.array([k[1] for k, _ in out], pa.int64()), pa.array([s for _, s in out], SPANS)], names=["h", "c", "spans"])

        for batch in batches:
            for h, c, single, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if size >= BATCH and h != last:
                    yield flush()
                    held, size = {}, 0
                held[h, c] = own, single
                size, last = size + len(own), h
        if held:
            yield flush()

    return parts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, spans array<struct<s:int,e:int>>")


def by_hashes(parts: DataFrame) -> DataFrame:
    """The same for anchors with very many stretches: passages are counted by two hashes, with a map-side combine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, single, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                data = np.frombuffer(own, np.uint8)
                s = np.arange(len(data) - PASSAGE + 1)
                n = len(s)
                one, two = (range_hashes(data, s, s + PASSAGE, base).view(np.int64) for base in (0x9FB21C651E98DF25, 0xD1342543DE82EF95))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, c)), pa.array(np.full(n, single)), pa.array(s.astype(np.int32)), pa.array(one), pa.array(two)], names=["h", "c", "single", "s", "w1", "w2"])

    every = parts.mapInArrow(run, "h long, c long, single boolean, s int, w1 long, w2 long")
    shared = every.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    found = every.where("single").join(shared, ["w1", "w2"])
    return found.groupBy("h", "c").agg(F.collect_list(F.struct("s", (F.col("s") + 1).alias("e"))).alias("spans"))


def repeats(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """``k1, k2, starts`` of ``rows(k1, k2, text)``: where repeated passages start, as an array of ranges ``s, e``.

    Every row is a document of its own, so passages of repeated rows repeat.
    Stretches of one anchor with the same 64-bit hash are the same; one of them
    is compared with the others of the anchor.
    """
    table = anchor_table(rows)
    again = kept(table.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    met = kept(table.join(again, "h"))
    any_place = [F.first(c).alias(c) for c in ("k1", "k2", "a", "b")]
    kinds = kept(met.groupBy("h", "c").agg(F.count("*").alias("n"), *any_place))
    several = kept(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    asked = kept(kinds.join(several, "h").select("h", "c", (F.col("n") == 1).alias("single"), "kinds", "k1", "k2", "a", "b"))
    whole = kinds.where("n > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("s"), (F.col("b") - F.col("a")).alias("e"))).alias("spans"))
    spans = whole.unionByName(by_suffixes(stretches(rows, asked.where(F.col("kinds") <= hot))))
    hotter = asked.where(F.col("kinds") > hot)
    if not hotter.isEmpty():
        spans = spans.unionByName(by_hashes(stretches(rows, hotter)))
    found = met.join(spans, ["h", "c"])
    return found.select("k1", "k2", "a", F.inline("spans")).groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("a") + F.col("s")).alias("s"), (F.col("a") + F.col("e")).alias("e"))).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` for every row.

    removed holds the maximal runs ``s, e`` of bytes that lie in a passage of
    PASSAGE bytes which also starts anywhere else, in the same text included;
    kept is what is left of the UTF-8 bytes.  Null texts are empty.  Texts
    shorter than a passage lose nothing.  Every row counts as a text of its
    own, so repeated rows lose all their passages.
    """
    rows = source(docs, id_col, text_col).select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    both = rows.join(repeats(rows.drop("doc_id"), hot), ["k1", "k2"], "left")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, left = [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                mark = np.zeros(len(data) + 1, np.int32)
                if own.is_valid:
                    np.add.at(mark, own.values.field("s").to_numpy(), 1)
                    np.add.at(mark, own.values.field("e").to_numpy() + PASSAGE - 1, -1)
                covered = np.cumsum(mark[:-1]) > 0
                size.append(len(data))
                gone.append(runs(covered))
                left.append(data[~covered].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, SPANS), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return both.select("doc_id", "text", "starts").mapInArrow(run, f"doc_id {kind}, n_bytes long, removed array<struct<s:int,e:int>>, kept binary")

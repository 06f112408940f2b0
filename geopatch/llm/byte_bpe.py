"""Byte-level BPE encoding and decoding through a shuffle of distinct words.

Texts are cut into pre-tokens.  A chunk of consecutive documents keeps its
documents as sequences of positions in the chunk's own list of distinct words,
and only these lists are exploded and shuffled: by word, so that each distinct
word meets all chunks that use it and is encoded once.  The ids then go back to
their chunk, where the documents are put together by position.  A very common
word costs one entry per chunk, however many rows hold it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import small_batches, source

#: Characters of text in a chunk; bounds the memory of a task.
CHUNK = 8 << 20
#: Tokens that are decoded at once, if a row has no more.
TOKENS = 1 << 19
#: Distinct words whose ids a task remembers at a time.
REMEMBER = 1 << 16


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(vocabulary), special_tokens={})


def pack(values: np.ndarray) -> bytes:
    """Small integers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + lengths[i] - 1 of all i, in order."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, ids_sha256`` for every row, as the tiktoken library encodes ordinary text.

    Null and empty texts have an empty array.  Repeated rows give repeated
    results.  ``vocabulary`` is the content of a rank file, ``pattern`` what
    splits texts before merging.  ids_sha256 is the lowercase hex digest of the
    ids as little-endian unsigned 32-bit integers.

    One shuffle places the documents by chunk and the lists of words by word;
    encoding reads its words from it, and putting together its documents.
    """
    rows = source(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["place", "chunk", "words", "sizes", "slots", "doc_id", "seq"]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, ordinal = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        slots: dict[str, int] = {}
        seqs: list[bytes] = []
        owners: list[pa.Array] = []
        size = check = 0

        def close() -> pa.RecordBatch:
            chunk = f"chunk {part} {ordinal} {check}"
            listed = [w.encode("utf-8", "surrogatepass") for w in slots]
            of = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int32, len(listed))
            order = np.argsort(of, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
            own = [[listed[i] for i in g] for g in groups]
            n, m = len(groups), len(seqs)
            ids = pa.concat_arrays(owners)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"words {of[g[0]]}" for g in groups] + [chunk] * m),
                    pa.array([chunk] * (n + m)),
                    pa.array([zlib.compress(b"".join(g), 1) for g in own] + [None] * m, pa.binary()),
                    pa.array([pack(np.fromiter(map(len, g), np.uint32, len(g))) for g in own] + [None] * m, pa.binary()),
                    pa.array([pack(np.diff(g, prepend=0)) for g in groups] + [None] * m, pa.binary()),
                    pa.concat_arrays([pa.nulls(n, ids.type), ids]),
                    pa.array([None] * n + seqs, pa.binary()),
                ],
                names=names,
            )

        for batch in batches:
            begun = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                seqs.append(pack(np.fromiter((slots.setdefault(w, len(slots)) for w in split(text)), np.uint32)))
                check = zlib.crc32(text.encode("utf-8", "surrogatepass"), check)
                size += len(text)
                if size >= CHUNK:
                    owners.append(batch.column(0).slice(begun, i + 1 - begun))
                    yield close()
                    slots, seqs, owners, size, begun, ordinal = {}, [], [], 0, i + 1, ordinal + 1
            if begun < batch.num_rows:
                owners.append(batch.column(0).slice(begun))
        if seqs:
            yield close()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = functools.lru_cache(maxsize=REMEMBER)(encoder(vocabulary, pattern)._encode_single_piece)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            lengths, found = [], []
            for own, sizes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own, ends = zlib.decompress(own), np.cumsum(unpack(sizes)).tolist()
                got = [merge(own[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                lengths.append(pack(np.fromiter(map(len, got), np.uint32, len(got))))
                found.append(pack(np.fromiter(itertools.chain.from_iterable(got), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(4), pa.array(lengths, pa.binary()), pa.array(found, pa.binary())], names=["place", "slots", "lengths", "ids"])

    def together(own: pa.Table, listed: pa.Table) -> pa.Table:
        own = own.filter(pc.is_valid(own["seq"]))
        join = lambda column: np.concatenate([np.zeros(0, np.uint32), *map(unpack, column)]).astype(np.int64)
        slots = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(x), dtype=np.int64) for x in listed["slots"].to_pylist())])
        lengths, flat = join(listed["lengths"].to_pylist()), join(listed["ids"].to_pylist()).astype(np.uint32)
        count, start = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        count[slots], start[slots] = lengths, np.cumsum(lengths) - lengths
        ends, parts, sums = [0], [flat[:0]], []
        for x in own["seq"].to_pylist():
            seq = unpack(x)
            parts.append(flat[ragged(count[seq], start[seq])])
            ends.append(ends[-1] + len(parts[-1]))
            sums.append(hashlib.sha256(parts[-1].astype("<u4").tobytes()).hexdigest())
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int32)))
        return pa.table([own["doc_id"], tokens, pa.array(sums, pa.string())], names=["doc_id", "ids", "ids_sha256"])

    placed = (
        rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(words, f"place string, chunk string, words binary, sizes binary, slots binary, doc_id {kind}, seq binary")
        .repartition("place")
    )
    ids = placed.mapInArrow(merged, "place string, slots binary, lengths binary, ids binary")
    return placed.groupBy("place").cogroup(ids.groupBy("place")).applyInArrow(together, f"doc_id {kind}, ids array<int>, ids_sha256 string")


def decode(encoded: DataFrame, vocabulary: bytes, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded binary``: the tokens' bytes one after the other.

    The token-byte table has one row per vocabulary entry, so its size is that
    of the rank file; it is joined on the side of the rows, by position.  Null
    ids give null; an id that is not in the vocabulary raises an error.
    """
    ranks = ranks_of(vocabulary)
    by_id: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    at = encoded.columns.index(ids_col)
    columns = [c for c in encoded.columns if c != "decoded"]
    fields = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "decoded")

    def cuts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lengths = pc.list_value_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // TOKENS
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in itertools.pairwise(edges) if b > a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(by_id, pa.binary())
        for batch in (part for whole in batches for part in cuts(whole)):
            ids = batch.column(at)
            tokens = table.take(ids.flatten())
            if tokens.null_count:
                raise ValueError("an id is not in the vocabulary")
            lengths = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pc.if_else(pc.is_valid(ids), joined, None)], names=[*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(run, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row: digests of the ids and of the bytes decoded from them."""
    coded = decode(encode(docs, vocabulary, pattern), vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

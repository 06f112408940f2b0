"""Line dedup: exact repeats, and lines within one edit of an earlier line.

Lines of WORDS words or more may differ in one word, shorter ones of CHARS
characters or more in one character.  Near lines meet in a deletion
neighbourhood: every line emits the hashes of itself and of all its variants
with one unit left out, equal hashes are joined, and the edit distance of those
that meet is verified.  Before that, lines that cannot have a partner are set
aside: two lines one edit apart have a start or an end of the same length in
common, so a line all of whose starts and ends occur nowhere else is alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, row_key, settled, sliced, small_batches

#: Words from which a line may differ in one word; characters from which a shorter one may differ in one character.
WORDS, CHARS = 10, 20
#: Lengths of the starts and ends that are compared; of any two consecutive ones the larger is at most twice the other.
LENGTHS = sorted(n << k for n in (2, 3) for k in range(40))
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def units(line: bytes, words: int = WORDS, chars: int = CHARS) -> tuple[list[bytes] | str, int]:
    """What an edit of a line changes, its words or its characters, and a number for the kind; none for very short lines."""
    split = line.split()
    if len(split) >= words:
        return split, 1
    text = line.decode("utf-8", "surrogatepass")
    return (text, 2) if len(text) >= chars else ("", 0)


def part_length(n: int) -> int:
    """The largest of LENGTHS that is below half of n units."""
    return LENGTHS[int(np.searchsorted(LENGTHS, (n - 1) // 2, "right")) - 1]


def parts(own: list[bytes] | str, kind: int) -> list[int]:
    """Hashes of starts and ends, of which two lines one edit apart share one at least: lines of n and n + 1 units both have those for n."""
    if not kind:
        return []
    digest, n, keys = xxhash.xxh3_64_intdigest, len(own), []
    for m in {part_length(n), part_length(n - 1)}:
        first, last = own[:m], own[n - m :]
        keys += [digest(b" ".join(first), 1), digest(b" ".join(last), 2)] if kind == 1 else [digest(first.encode("utf-8", "surrogatepass"), 3), digest(last.encode("utf-8", "surrogatepass"), 4)]
    return keys


def variants(own: list[bytes] | str, kind: int) -> np.ndarray:
    """Hashes of a line without its first, second, ... unit, and last of the whole line."""
    if kind == 1:
        values = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), np.uint64, len(own))
    else:
        values = (np.frombuffer(own.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)) * MIX
        values ^= values >> np.uint64(29)
    powers = np.full(len(own), BASE, np.uint64)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(BASE, -1, 1 << 64))
    return np.concatenate([without, sums[-1:]]) + np.uint64(kind)


def one_apart(a, b) -> bool:
    """Whether two sequences are at edit distance one at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def line_table(rows: DataFrame, words: int, chars: int) -> DataFrame:
    """``doc_id, k1, k2, line, c1, c2, parts`` of every line that is not blank; c1 and c2 stand for the trimmed line."""
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            of, numbers, classes, keys = [], [], [], []
            for i, text in enumerate(batch.column(3)):
                for number, line in enumerate(text.as_py().encode("utf-8", "surrogatepass").split(b"\n")):
                    if line := line.strip():
                        of.append(i)
                        numbers.append(number)
                        classes.append(xxhash.xxh3_128_digest(line))
                        keys.append(parts(*units(line, words, chars)))
            whole = np.frombuffer(b"".join(classes), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys], dtype=np.int64)])
            flat = pa.array(signed([x for k in keys for x in k]))
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(3)), pa.array(numbers, pa.int32()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["doc_id", "k1", "k2", "line", "c1", "c2", "parts"],
            )

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, k1 long, k2 long, line int, c1 long, c2 long, parts array<long>")


def lines_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``place, text`` of the lines at ``places(place)``."""
    asked = few(kept(places.groupBy("place.k1", "place.k2").agg(F.collect_list("place.line").alias("asked"))))
    both = rows.join(asked, ["k1", "k2"]).withColumn("lines", F.split("text", "\n"))
    split = both.select("doc_id", "k1", "k2", F.explode("asked").alias("line"), "lines")
    return split.select(F.struct("doc_id", "line", "k1", "k2").alias("place"), F.get("lines", F.col("line")).alias("text")).distinct()


def near_lines(lines: DataFrame, words: int, chars: int) -> DataFrame:
    """``place`` of the lines of ``lines(place, text)`` that are one edit from an earlier one; no two lines are the same.

    Lines that share a variant and the place of the missing unit differ in one
    unit, so each is compared with the earliest of them only; a line and those
    that become it by leaving out a unit are compared likewise.  The work is
    linear in the variants, however many lines share one.
    """
    kind = lines.select("place.*").schema
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [variants(*units(t.as_py().encode("utf-8", "surrogatepass").strip(), words, chars)) for t in batch.column(1)]
            sizes = np.array([len(m) for m in made], np.int64)
            gaps = np.concatenate([[*range(n - 1), -1] for n in sizes]) if len(sizes) else np.zeros(0)
            at = pa.array(np.repeat(np.arange(len(made)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(gaps.astype(np.int32)), pa.array(np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64))], names=["place", "gap", "key"])

    every = lines.mapInArrow(run, f"place struct<{fields}>, gap int, key long")
    shared = kept(every.groupBy("key").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most").select("key"))
    met = kept(every.join(few(shared), "key"))
    short, whole = met.where("gap >= 0"), met.where("gap < 0").select("key", F.col("place").alias("other"))
    replaced = short.join(few(kept(short.groupBy("key", "gap").agg(F.min("place").alias("other")))), ["key", "gap"]).select("place", "other")
    longer = short.join(whole, "key").select("place", "other")
    shorter = whole.withColumnRenamed("other", "place").join(short.groupBy("key").agg(F.min("place").alias("other")), "key").select("place", "other")
    pairs = replaced.union(longer).union(shorter).where("other < place").distinct()
    texts = pairs.join(lines, "place").join(lines.select(F.col("place").alias("other"), F.col("text").alias("other_text")), "other")

    def fits(a: str, b: str) -> bool:
        (x, k), (y, m) = (units(t.encode("utf-8", "surrogatepass").strip(), words, chars) for t in (a, b))
        return k == m and one_apart(x, y)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["place"]).filter(pa.array([fits(a.as_py(), b.as_py()) for a, b in zip(batch.column(1), batch.column(2), strict=True)], pa.bool_()))

    return texts.select("place", "text", "other_text").mapInArrow(verified, f"place struct<{fields}>").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of the text, and ``n_lines, n_exact, n_near``.

    A line is taken out as exact if the same line, blanks around it aside,
    stands at an earlier place, and as near if the first place of the same line
    comes after a line at an edit distance of one: of words, if both have at
    least ``words``, or of characters, if both have fewer words and at least
    ``chars`` characters.  The order is by id, then by line, nulls first;
    between rows of one id, at the same line, it is by a hash of the text, so
    that repeated rows keep the same lines.  Blank lines stay.  A null text
    stays null, with no lines.  Columns of the names of the three counts are
    replaced; the others are kept.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")
    place = F.struct("doc_id", "line", "k1", "k2").alias("place")
    with settled(docs.sparkSession):
        table = kept(line_table(rows, words, chars))
        parts_of = table.select(F.explode("parts").alias("part"), "c1")
        twice = kept(parts_of.groupBy("part").agg(F.min("c1").alias("least"), F.max("c1").alias("most")).where("least < most").select("part"))
        candidates = parts_of.join(few(twice), "part").select("c1").distinct()
        classes = kept(table.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
        asked = classes.join(few(kept(candidates)), "c1", "left_semi").select(F.col("first").alias("place"))
        near = near_lines(kept(lines_at(rows, asked)), words, chars).withColumnRenamed("place", "first").withColumn("near", F.lit(True))
        decided = few(kept(classes.join(few(kept(near)), "first", "left").where("near or n > 1").select("c1", "c2", "first", F.coalesce("near", F.lit(False)).alias("near"))))
        out = table.select("c1", "c2", place).join(decided, ["c1", "c2"]).where("near or first < place")
        exact = (F.col("first") < F.col("place")).alias("exact")
        removed = out.select("place.k1", "place.k2", "place.line", exact).distinct().groupBy(F.col("k1").alias("own_k1"), F.col("k2").alias("own_k2"))
        removed = kept(removed.agg(F.collect_list("line").alias("gone"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near")))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    whole = docs.select(F.struct(*columns).alias("doc"))
    key = row_key(F.col("doc")[id_col], F.coalesce(F.col("doc")[text_col], F.lit("")))
    text = F.col("doc")[text_col]
    both = whole.join(removed, (key[0] == F.col("own_k1")) & (key[1] == F.col("own_k2")), "left")
    lines = F.split(text, "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    total = F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")), F.lit(0)).cast("long")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near")]
    kept_text = F.when(F.col("gone").isNull(), text).otherwise(left)
    return both.select(*[(kept_text if c == text_col else F.col("doc")[c]).alias(c) for c in columns], total.alias("n_lines"), *counts)

"""Source divergence audit: how far the word distributions of the sources of a language are apart.

The counts of each language are a matrix of groups by terms.  It is cut into
blocks of columns, each a task's k^2-tree: squares without any count are
leaves.  All pairs of groups go down a block's tree together; where both
squares of a pair are empty, its terms cost the difference of the two groups'
constant shares each, and only single cells with a count are looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopatch.llm.common import few, kept, sliced, small_batches

#: Every byte but ASCII letters and those of non-ASCII characters becomes a blank.
BLANK = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))
#: Terms that a task holds before it passes their counts on.
ENTRIES = 400_000
#: Terms of a block and groups of one of its sides.
COLUMNS, ROWS = 4096, 128
#: Pairs of squares that go down a tree at a time.
FRONTIER = 1 << 17


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each term, as far as a task has added them up, from ``docs(lang, source, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        df: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                own = df[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([own[t] for t in counts], pa.int64())],
                    names=["lang", "source", "term", "n", "df"],
                )
            n.clear()
            df.clear()

        for batch in sliced(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                terms = text.as_py().lower().translate(BLANK).split()
                n[lang, source].update(terms)
                df[lang, source].update(set(terms))
            if sum(map(len, n.values())) > ENTRIES:
                yield from flush()
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1,000,000,000 (count + 5) / (total + 5 terms)), exactly."""
    wide = lambda x: x.cast("decimal(18, 0)")
    top, bottom = F.lit(1_000_000_000).cast("decimal(10, 0)") * wide(count + 5), wide(total + 5 * terms)
    return (1 + F.call_function("div", top, bottom)).cast("long")


def tree(counts: np.ndarray) -> list[np.ndarray]:
    """Levels of the k^2-tree (k = 2) of a matrix with sides of powers of two, single cells first: whether a square holds a count."""
    levels = [counts]
    while max(levels[-1].shape) > 1:
        m = levels[-1]
        m = m if m.shape[0] == 1 else m[0::2] | m[1::2]
        levels.append(m if m.shape[1] == 1 else m[:, 0::2] | m[:, 1::2])
    return levels


def padded(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def distances(left: np.ndarray, right: np.ndarray, zero_left: np.ndarray, zero_right: np.ndarray, same: bool = False) -> np.ndarray:
    """The sum of |p - q| over a block's terms for each row of ``left`` and each of ``right``: shares, 0 where a group has no count.

    A group's share of a term it does not count is ``zero_left`` or
    ``zero_right``.  With ``same``, both sides are one matrix and only the part
    above the diagonal is right.  Sums of a block stay below 2^53.
    """
    columns, side = left.shape[1], padded(max(len(left), len(right)))
    width = padded(columns)

    def spread(m: np.ndarray) -> np.ndarray:
        return np.pad(m, ((0, side - m.shape[0]), (0, width - columns)))

    a, b = spread(left), spread(right)
    za, zb = np.pad(zero_left, (0, side - len(left))), np.pad(zero_right, (0, side - len(right)))
    trees = tree(a != 0), tree(b != 0)
    empty = [np.zeros((m.shape[0],) * 2) for m in trees[0]]
    out = np.zeros(side * side)
    root = np.zeros(1, np.int64)
    todo = [(len(trees[0]) - 1, root, root, root)]
    while todo:
        level, i, j, c = todo.pop()
        if same:
            i, j, c = (x[i <= j] for x in (i, j, c))
        full = trees[0][level][i, c] | trees[1][level][j, c]
        n, wide = empty[level].shape[0], min(1 << level, width)
        terms = np.clip(columns - c[~full] * wide, 0, wide)
        empty[level] += np.bincount(i[~full] * n + j[~full], terms, n * n).reshape(n, n)
        i, j, c = i[full], j[full], c[full]
        if level == 0:
            p, q = a[i, c], b[j, c]
            out += np.bincount(i * side + j, np.abs(np.where(p == 0, za[i], p) - np.where(q == 0, zb[j], q)), side * side)
        elif len(i):
            rows, cols = (below // own for below, own in zip(trees[0][level - 1].shape, trees[0][level].shape, strict=True))
            d, e, f = (x.ravel()[:, None] for x in np.indices((rows, rows, cols)))
            i, j, c = ((x * n + k).ravel() for x, n, k in ((i, rows, d), (j, rows, e), (c, cols, f)))
            todo += [(level - 1, i[at : at + FRONTIER], j[at : at + FRONTIER], c[at : at + FRONTIER]) for at in range(0, len(i), FRONTIER)]
    priced = sum(m.repeat(side // len(m), 0).repeat(side // len(m), 1) for m in empty).astype(np.int64)
    found = out.reshape(side, side).astype(np.int64) + priced * np.abs(za[:, None] - zb[None, :])
    return found[: len(left), : len(right)]


def block_distances(block: pa.Table, rows: int) -> pa.Table:
    """``lang, a, b, value, seen`` of all pairs of groups of a block: those of its two sides, or of its only side.

    seen is the number of terms that the sides hold, over which value is the distance.
    """
    lang, low, high = (block[c][0].as_py() for c in ("lang", "low", "high"))
    r, zero, p = (block[c].to_numpy() for c in ("r", "zero", "p"))
    term = block["term"].combine_chunks().dictionary_encode()
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    cells = ~np.isnan(term.indices.to_numpy(zero_copy_only=False).astype(float))
    column = np.nan_to_num(term.indices.to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)

    def part(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        head, own = ~cells & (r // rows == k), cells & (r // rows == k)
        names, at = np.sort(r[head]), np.argsort(r[head])
        m = np.zeros((len(names), max(1, len(term.dictionary))), np.int64)
        m[np.searchsorted(names, r[own]), column[own]] = p[own]
        return names, zero[head][at], m

    one, two = part(low), part(high)
    m, seen = distances(one[2], two[2], one[1], two[1], low == high), one[2].shape[1]
    i, j = np.triu_indices(len(one[0]), 1) if low == high else (x.ravel() for x in np.indices(m.shape))
    columns = [pa.array([lang] * len(i), pa.string()), pa.array(one[0][i], pa.int32()), pa.array(two[0][j], pa.int32()), pa.array(m[i, j], pa.int64()), pa.array([seen] * len(i), pa.int64())]
    return pa.Table.from_arrays(columns, names=["lang", "a", "b", "value", "seen"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50, columns: int = COLUMNS, side: int = ROWS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which terms.

    Null texts, languages and sources are empty strings.  A language keeps the
    terms of at least ``least`` of its rows; repeated rows count as often as
    they stand.  Part ``pair`` ranks all other sources by distance, part
    ``term`` the first ``top`` terms that the source has more of than its
    language.  Ties go by item.  Pairs of a language are as many as its sources
    squared; everything else is shuffled by term or block.
    """
    small_batches(docs.sparkSession)
    plain = lambda c: F.coalesce(docs[c], F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    by_term = counted(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    cells = by_term.withColumns({"lang_n": F.sum("n").over(term), "all_df": F.sum("df").over(term), "head": (F.row_number().over(term.orderBy("source")) == 1).cast("long")})
    cells = kept(cells.where(F.col("all_df") >= least).select("lang", "source", "term", "n", "lang_n", "head"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    whole = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(kept(totals), ["lang", "source"], "left").na.fill(0, ["total", "heads"])
    groups = groups.withColumns({"lang_total": F.sum("total").over(whole), "terms": F.sum("heads").over(whole), "r": F.row_number().over(whole.orderBy("source")) - 1, "size": F.count("*").over(whole)}).drop("heads")
    groups = kept(groups.withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))))
    priced = cells.join(few(groups), ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
    return of_terms(priced, top).unionByName(of_pairs(priced, groups, columns, side))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def of_terms(priced: DataFrame, top: int) -> DataFrame:
    """Part ``term``.  Spark keeps the first ``top`` of each task before the shuffle."""
    return ranked(priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top)


def of_pairs(priced: DataFrame, groups: DataFrame, columns: int, side: int) -> DataFrame:
    """Part ``pair``: sums of the blocks' distances; a block has about so many ``columns``, a side of it up to ``side`` groups, and each cell goes to all pairs of sides that hold it.  Terms that no group of two sides counts are priced at the end."""
    blocks, sides = F.ceil(F.col("terms") / columns).cast("int"), F.ceil(F.col("size") / side).cast("int")
    own = F.floor(F.col("r") / side).cast("int")
    heads = groups.where("terms > 0").select("lang", "r", "zero", "size", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"))
    cells = priced.select("lang", "r", "zero", "size", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "term", "p")
    both = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    both = both.withColumns({"low": F.least(own, "other"), "high": F.greatest(own, "other")}).drop("other", "size")
    sums = both.groupBy("lang", "block", "low", "high").applyInArrow(lambda block: block_distances(block, side), "lang string, a int, b int, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    name = few(groups.select("lang", "r", "source", "zero", "terms"))
    one, two = name.withColumnsRenamed({"r": "a", "source": "one", "zero": "zero_one"}), name.drop("terms").withColumnsRenamed({"r": "b", "source": "two", "zero": "zero_two"})
    named = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    named = named.withColumn("value", F.col("value") + (F.col("terms") - F.col("seen")) * F.abs(F.col("zero_one") - F.col("zero_two")))
    directed = F.inline(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = named.select("lang", "value", directed)
    blank = groups.where("terms = 0").select("lang", "source")
    zero = blank.join(blank.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return ranked(pairs.unionByName(zero).select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

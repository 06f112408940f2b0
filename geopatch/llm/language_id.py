"""Language identification by interpolated Kneser-Ney character models.

Text is read as runs of letters in lower case, each between a start and an end
mark; contexts do not reach over a word's start.  Four symbols of 16 bits make
one 64-bit n-gram code.  Spark counts the codes of all training texts and
estimates all orders of the models in tables.

A model is stored as sorted arrays of codes with weights that add up: each
order adds the log back-off weight of the context, if it is known, and for a
known n-gram what its own log probability has beyond that.  So a model of any
size can be cut into shards, of which each text is scored by one after the
other, and the sums are the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from geopatch.llm.common import few, kept, row_key, sliced, small_batches

ORDER, START, END = 4, 1, 2
WORD = regex.compile(r"\p{L}+")
UNKNOWN = "und"
#: Characters of text whose words a task counts before it passes them on.
TEXT_HELD = 8 << 20
#: Entries of a shard, of 16 bytes each; bounds what is sent to the driver and the workers at a time.
SHARD = 1 << 22
#: Labelled rows of which one is set aside to calibrate the rejection, and rows that a language needs for limits of its own.
ASIDE, OWN_LIMITS = 16, 20


def letters(text: str) -> list[str]:
    return WORD.findall(text.lower())


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram codes of all words, and the number of each word's codes.

    Symbols beyond 16 bits are folded into the private-use range.
    """
    marked = "".join(f"\x01\x01\x01{w}\x02" for w in words)
    symbols = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    symbols = np.where(symbols > 0xFFFF, 0xE000 + symbols % 6400, symbols)
    codes = (symbols[:-3] << 48) | (symbols[1:-2] << 32) | (symbols[2:-1] << 16) | symbols[3:]
    return codes[symbols[3:] != START], np.fromiter((len(w) + 1 for w in words), np.int64, len(words))


def weighted(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of counted words, sorted, and their counts."""
    codes, lengths = codes_of(list(words))
    found, where = np.unique(codes, return_inverse=True)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), lengths)
    return found, np.bincount(where, times, len(found)).astype(np.int64)


def kneser_ney(counted: DataFrame) -> DataFrame:
    """``lang, level, grams, code, weight``: the interpolated models of distinct n-grams with their counts, ``counted(lang, code, n)``.

    Lower orders count the distinct symbols before.  A row is an n-gram or,
    where ``grams`` is false, a context; orders have their discounts for each
    language from all n-grams that stand once and twice.  Level 0 holds the
    log probability of a symbol that was never seen.
    """
    raw = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):
        own = F.col("code").bitwiseAND(F.lit((1 << 16 * k) - 1))
        raw[k] = kept(raw[k + 1].groupBy("lang", own.alias("code")).agg(F.count("*").alias("n")))
    floor = kept(raw[1].groupBy("lang").agg((-F.log(F.count("*") + 1.0)).alias("floor")))
    found = floor.select("lang", F.lit(0).alias("level"), F.lit(True).alias("grams"), F.lit(0).cast("long").alias("code"), F.col("floor").alias("weight"))
    lower = floor.select("lang", F.lit(0).cast("long").alias("suffix"), F.col("floor").alias("below"))
    for k in range(1, ORDER + 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discounts = raw[k].groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"))
        grams = raw[k].withColumns({"context": F.shiftrightunsigned("code", 16), "suffix": F.col("code").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))}).join(few(kept(discounts)), "lang")
        back = F.first("discount") * F.count("*") / F.sum("n")
        contexts = kept(grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.log(back).alias("back")))
        joined = grams.join(few(contexts), ["lang", "context"]).join(few(lower), ["lang", "suffix"])
        p = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.exp(F.col("back") + F.col("below"))
        level = kept(joined.select("lang", "code", F.log(p).alias("log_p"), (F.log(p) - F.col("back") - F.col("below")).alias("weight")))
        lower = level.select("lang", F.col("code").alias("suffix"), F.col("log_p").alias("below"))
        for part, is_gram in ((level.select("lang", "code", "weight"), True), (contexts.select("lang", F.col("context").alias("code"), F.col("back").alias("weight")), False)):
            found = found.unionByName(part.withColumns({"level": F.lit(k), "grams": F.lit(is_gram)}))
    return kept(found)


class Shard:
    """A part of all models: for each language, level and kind sorted codes with their weights."""

    def __init__(self, rows: pa.Table, names: list[str]):
        langs = rows["lang"].combine_chunks().dictionary_encode()
        number = np.array([names.index(x) for x in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
        kind = (number * (ORDER + 1) + rows["level"].to_numpy()) * 2 + rows["grams"].to_numpy(zero_copy_only=False)
        codes, weights = rows["code"].to_numpy().view(np.uint64), rows["weight"].to_numpy()
        order = np.lexsort((codes, kind))
        ends = np.searchsorted(kind[order], np.arange(2 * (ORDER + 1) * len(names) + 1))
        self.parts = [(codes[own], weights[own]) for own in (order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
        self.n = len(names)

    def log_probs(self, codes: np.ndarray) -> np.ndarray:
        """This shard's part of the natural log of the probability of each code's last symbol after the others, for each language."""
        out = np.zeros((self.n, len(codes)))
        for level in range(ORDER + 1):
            for grams in range(2):
                keys = codes & np.uint64((1 << 16 * level) - 1)
                own, where = np.unique(keys if grams else keys >> np.uint64(16), return_inverse=True)
                for k in range(self.n):
                    known, weights = self.parts[(k * (ORDER + 1) + level) * 2 + grams]
                    if len(known):
                        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        out[k] += np.where(known[at] == own, weights[at], 0.0)[where]
        return out


def shards(models: DataFrame, size: int) -> Iterator[pa.Table]:
    """The rows of all models in parts of about ``size``, one after the other; a single empty one if there are none."""
    n = max(1, -(-models.count() // size))
    for k in range(n):
        yield models.where(F.pmod(F.xxhash64("lang", "level", "grams", "code"), F.lit(n)) == k).toArrow()


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """``lang, code, n`` over all rows of ``labelled(lang, text)``; null texts and labels are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in words.items():
                if own:
                    codes, n = weighted(own)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])
            words.clear()

        for batch in sliced(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letters(text))
                held += len(text)
                if held >= TEXT_HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> DataFrame:
    """The models of all labels, from the counts over all rows of ``labelled(lang, text)``."""
    return kneser_ney(kept(count_ngrams(labelled)))


def sums_of(rows: DataFrame, part: pa.Table, names: list[str]) -> DataFrame:
    """Adds to ``rows`` one shard's ``sums`` of log probabilities by language, and ``n_symbols``, for the whole texts in the first column, which goes."""
    held = rows.sparkSession.sparkContext.broadcast(Shard(part, names))
    fields = [*rows.schema.fields[1:], StructField("sums", ArrayType(DoubleType())), StructField("n_symbols", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held.value
        for batch in sliced(batches):
            slots: dict[str, int] = {}
            owned = [np.fromiter((slots.setdefault(w, len(slots)) for w in letters(t or "")), np.int64) for t in batch.column(0).to_pylist()]
            size = np.fromiter(map(len, owned), np.int64, len(owned))
            sums, symbols = np.zeros((len(owned), len(names))), np.zeros(len(owned), np.int64)
            if slots:
                codes, lengths = codes_of(list(slots))
                unique, where = np.unique(codes, return_inverse=True)
                starts, flat, full = np.cumsum(lengths) - lengths, np.concatenate(owned), size > 0
                firsts = (np.cumsum(size) - size)[full]
                for k, own in enumerate(shard.log_probs(unique)):
                    sums[full, k] = np.add.reduceat(np.add.reduceat(own[where], starts)[flat], firsts)
                symbols[full] = np.add.reduceat(lengths[flat], firsts)
            ends = np.arange(len(owned) + 1, dtype=np.int32) * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.reshape(-1))), pa.array(symbols)], names=[f.name for f in fields])

    return rows.mapInArrow(run, StructType(fields))


def score(docs: DataFrame, models: DataFrame, text_col: str = "text", keep: list[str] | None = None, shard: int = SHARD) -> DataFrame:
    """The ``keep`` columns (else doc_id alone) and ``lang_pred, score, bits, n_symbols`` of every row, over whole texts.

    lang_pred is the label with the lowest cross-entropy per symbol (``bits``;
    of equal ones the first by name); score is its share under a softmax of the
    languages' log probabilities, over at most 64 symbols' worth.  A null text
    or one without letters is ``und`` with score 0 and null bits, and so is
    every text if there are no models.  Models of more than one shard cost a
    pass over the texts for each, and a join of the sums.
    """
    keep = ["doc_id"] if keep is None else keep
    names = sorted(r["lang"] for r in models.select("lang").distinct().collect())
    parts = list(shards(models, shard)) if models.count() <= shard else shards(models, shard)
    rows = docs.select(docs[text_col].alias("scored"), *keep)
    if isinstance(parts, list):
        added = sums_of(rows, parts[0], names)
    else:
        key = docs.select(docs[text_col].alias("scored"), *row_key(F.lit(0), F.coalesce(docs[text_col], F.lit("")))).dropDuplicates(["k1", "k2"])
        every = [kept(sums_of(key, part, names)) for part in parts]
        total = every[0]
        for more in every[1:]:
            both = total.join(more.select("k1", "k2", F.col("sums").alias("more")), ["k1", "k2"])
            total = kept(both.select("k1", "k2", F.zip_with("sums", "more", lambda a, b: a + b).alias("sums"), "n_symbols"))
        k1, k2 = row_key(F.lit(0), F.coalesce(F.col("scored"), F.lit("")))
        added = rows.join(total, (k1 == total["k1"]) & (k2 == total["k2"])).drop("scored", total["k1"], total["k2"])
    known = (F.col("n_symbols") > 0) & F.lit(bool(names))
    cross = F.transform("sums", lambda x: -x / F.col("n_symbols"))
    low = F.array_min("cross")
    share = 1 / F.aggregate("cross", F.lit(0.0), lambda a, x: a + F.exp(-(x - low) * F.least(F.col("n_symbols"), F.lit(64))))
    found = added.withColumn("cross", F.when(known, cross))
    best = F.get(F.array(*map(F.lit, [*names, UNKNOWN])), F.coalesce(F.array_position("cross", low) - 1, F.lit(len(names))).cast("int"))
    return found.select(*keep, best.alias("lang_pred"), F.when(known, share).otherwise(0.0).alias("score"), (low / F.log(F.lit(2.0))).alias("bits"), "n_symbols")


def excess_of(centre: Column) -> Column:
    """Bits above a centre, in units of a spread that falls with the length down to that of 500 symbols."""
    return (F.col("bits") - centre) / F.sqrt(1 / F.col("n_symbols") + 1 / 500)


def calibrate(labelled: DataFrame, models: DataFrame, tail: float = 0.999, slack: float = 2.0) -> dict[str, tuple[float, float]]:
    """``lang -> (centre, reach)``: a text is rejected if its excess over the centre exceeds reach.

    The centre is the median of the bits of a language's own texts in
    ``labelled``, which the models have not seen; the reach is the ``tail``
    quantile of the excess, times ``slack``.  Languages with fewer than
    OWN_LIMITS texts there have no limit.
    """
    scored = kept(score(labelled, models).where("bits is not null"))
    centres = few(kept(scored.groupBy("lang_pred").agg(F.percentile_approx("bits", 0.5, 10000).alias("centre"), F.count("*").alias("n")).where(F.col("n") >= OWN_LIMITS)))
    rows = scored.join(centres, "lang_pred").groupBy("lang_pred", "centre").agg(F.percentile_approx(excess_of(F.col("centre")), tail, 10000).alias("reach"))
    return {r["lang_pred"]: (r["centre"], max(r["reach"], 1.0) * slack) for r in rows.collect()}


def accepted(limits: dict[str, tuple[float, float]]) -> Column:
    """Whether a scored row is within its language's calibrated limit; never for ``und``.

    Texts of languages without a limit, which had too few texts to set one,
    are accepted.
    """
    within = F.lit(True)
    for lang, (centre, reach) in limits.items():
        within = F.when(F.col("lang_pred") == lang, excess_of(F.lit(centre)) <= reach).otherwise(within)
    return (F.col("lang_pred") != UNKNOWN) & within


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fitted(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Models of the labelled rows outside the held-out fold, and the column that tells whether a scored row is accepted.

    One row in ASIDE of these is not learnt from but sets the rejection limits.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where((fold(docs["doc_id"]) != 1) & docs["lang"].isNotNull() & docs["text"].isNotNull()).select("doc_id", "lang", "text")
    aside = F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(ASIDE)) == 0
    models = fit(labelled.where(~aside))
    return models, accepted(calibrate(labelled.where(aside), models))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits, accepted`` for every row of ``docs(doc_id, text, lang)``.

    Models and limits come from all rows outside the held-out fold that have a
    label.  held_out is null for a null id, which is never learnt from.
    Repeated rows are learnt from and reported as often as they stand.
    """
    models, fits = fitted(docs)
    return score(docs, models).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "bits", fits.alias("accepted"))


def known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang)`` whose language is accepted, with their columns.

    Texts that are null or without letters go.  Columns named lang_pred, score,
    bits and n_symbols are not looked at and are kept as they are.
    """
    models, fits = fitted(docs)
    clash = {c: f"own {c}" for c in ("lang_pred", "score", "bits", "n_symbols", "sums", "cross", "scored") if c in docs.columns}
    rows = docs.withColumnsRenamed(clash)
    return score(rows, models, keep=rows.columns).where(fits).select(*rows.columns).withColumnsRenamed({v: k for k, v in clash.items()})

"""A pipeline that turns raw documents into token ids, one operator a stage.

Each stage takes (spark, docs, sf_dir); all but the last return documents, with
the columns of the table and no others.  Rows with a null id are kept and
judged like any others, except that near copies are looked for among rows with
an id only.  Repeated rows stay until the near-copy stage, which keeps one of
each.  Empty tables stay empty.

This file goes with the text subpackage: without that it cannot be imported.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopatch.llm import byte_bpe, decontamination, language_id, line_dedup, near_copies, simhash
from geopatch.llm.common import drop, kept, noted, read, settled
from geopatch.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; null texts and those without letters go."""
    return language_id.known(docs).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line at its earliest place only; those that lose all their lines go, those that had none stay."""
    left = line_dedup.dedup(docs).where("n_lines = 0 or n_exact + n_near < n_lines")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash class; of those, the ones that share less than 0.8 of their five-word shingles with any earlier one.

    Fingerprints at 2 bits link what is equal or almost so; the exact join
    after them finds the pairs whose fingerprints lie further apart.
    """
    own = docs.select(*COLUMNS)
    with settled(spark):
        later = simhash.later(own, shingle=3, radius=2)
        left = near_copies.keep_first(own, without=later)
    return left.select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes decoded from them."""
    words = vocabulary("byte_bpe_50k.tiktoken")
    # written in between, so that no task holds workers of three functions at a time
    coded = byte_bpe.decode(kept(byte_bpe.encode(docs, words, public_tokenizers.PATTERN)), words)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", token_ids),
]

#: SQL expresses neither the language models nor the tokenizer; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage has written on its way, and its input, go when its result is there."""
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with noted() as made:
            docs = kept(stage(spark, docs, sf_dir))
        drop(spark, before + made[:-1])
        before = made[-1:]
    return docs

"""Texts of megabytes, and columns with the names that operators use inside."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from geopatch.llm import byte_bpe, collocations, decontamination, divergence, line_dedup, near_copies, secrets, spot_signatures, suffix_dedup, token_counts, warc
from geopatch.llm.queries import vocabulary

QUESTION = "which of the seven old bridges over the river was the first to be built of stone and who paid for the work"
INSIDE = ["k1", "k2", "text_key", "sigs", "tokens", "removed", "kept", "n_bytes", "anchor", "size", "key", "keys", "prefix", "next", "term", "digest", "first", "page_id", "hash", "n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = [a + b for a in "ba de fi go lu mer nos pal rin tus ö".split() for b in "ka lo mi net rus é".split()] + ["the", "of", "in"]
    half = " ".join(rng.choices(words, k=150_000))
    flat = f"{half} {QUESTION} " + " ".join(rng.choices(words, k=150_000))
    lines = "\n".join(" ".join(rng.choices(words, k=14)) if k % 3 else f"this line stands very often in a text of many lines, as number one of {k % 7} does" for k in range(30_000))
    return {1: flat, 2: lines, 3: "a short text", 4: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    return rows.withColumns({c: F.lit("x") for c in INSIDE})


def of(df, column):
    return {r["doc_id"]: r[column] for r in df.select("doc_id", column).collect()}


def test_whole_texts_are_fingerprinted_and_compared(docs, texts):
    got = of(spot_signatures.compare_with_next(docs), "edited_sha256")
    part = len(texts[1]) // 4
    assert got[1] == sha(texts[1][: len(texts[1]) - part] + texts[2][:part])


def test_whole_texts_are_coded_and_counted(docs, texts):
    coded = byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert of(coded, "decoded_sha256") == {i: sha(t or "") for i, t in texts.items()}
    assert of(token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")), "n_tokens")[1] > 300_000


def test_an_item_in_the_middle_is_found(spark, docs):
    items = spark.createDataFrame([(5, QUESTION)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()] == [(1, 5)]


def test_repeated_lines_and_passages_go(docs, texts):
    left = of(line_dedup.dedup(docs), "text")
    assert left[1] == texts[1] and left[2].count("stands very often") <= 7
    kept = of(suffix_dedup.remove_repeats(docs), "kept")
    assert bytes(kept[3]).decode() == texts[3] and len(kept[1]) == len(texts[1].encode())


def test_scans_and_copies(docs, texts):
    assert {i: len(b) for i, b in of(secrets.scan(docs), "base").items()} == dict.fromkeys(texts, 0)
    doubled = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))
    assert sorted(r["doc_id"] for r in near_copies.keep_first(doubled).collect() if r["text"]) == [1, 2, 3]


def test_counts_of_words(docs, texts):
    found = collocations.collocations(docs).select("n").distinct().collect()
    pieces = sum(len([w for w in (t or "").replace("\n", " ").replace(",", " ").split(" ") if w]) for t in texts.values())
    assert [r["n"] for r in found] == [pieces]
    assert divergence.audit(docs, least=1).where("part = 'pair'").count() == 12


def test_pages_of_megabytes(spark, texts):
    pages = spark.createDataFrame([(1, "u", texts[1]), (2, "u", texts[1]), (3, "u", texts[2])], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.report(pages).collect())
    assert got == [(1, len(texts[1].encode()), sha(texts[1]), "response", None), (2, len(texts[1].encode()), sha(texts[1]), "revisit", 1), (3, len(texts[2].encode()), sha(texts[2]), "response", None)]

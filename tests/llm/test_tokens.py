import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from geopatch.llm import byte_bpe, token_counts
from geopatch.llm.queries import vocabulary

ALPHABET = "abc XYZ  \n\t'sé漢字🙂12 345.,!▁ \x1c ǅ<s>"


def texts():
    rng = random.Random(2)
    odd = ["", " ", "   ", "a", "don't we'll  x", "<|endoftext|> <s> </s> <unk>", "\x00\x01", "word " * 9000, "x" * 3000, " a  b\n\n c ", "ab" + " " * 50 + "c", "  lead", "trail  "]
    return odd + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1000, None, None), (1001, "same row", "y"), (1001, "same row", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def key(row):
    return (row["doc_id"] is None, row["doc_id"])


def test_encoding_is_the_librarys(docs, monkeypatch):
    words = vocabulary("byte_bpe_50k.tiktoken")
    coder = byte_bpe.encoder(words, public_tokenizers.PATTERN)
    want = []
    for r in sorted(docs.collect(), key=key):
        ids = coder.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    for partitions in (1, 5):
        found = byte_bpe.round_trip(docs.repartition(partitions), words, public_tokenizers.PATTERN)
        assert [tuple(r) for r in sorted(found.collect(), key=key)] == want


def test_decoding_gives_the_text_back(docs):
    words = vocabulary("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, words, public_tokenizers.PATTERN), words)
    got = sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in decoded.collect())
    assert got == sorted((r["doc_id"] or -1, (r["text"] or "").encode()) for r in docs.collect())


def test_an_unknown_id_is_an_error(spark):
    rows = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="(?i)index|vocabulary"):
        byte_bpe.decode(rows, vocabulary("byte_bpe_50k.tiktoken")).collect()


def test_packing():
    for values in ([], [0], [1, 2, 300, 70000], list(range(1000))):
        assert byte_bpe.unpack(byte_bpe.pack(np.array(values, np.uint32))).tolist() == values


def test_token_counts_are_the_librarys(docs):
    model = vocabulary("piece_bpe_32k.model")
    sp = token_counts.processor(model)
    assert token_counts.splittable(model)
    got = [tuple(r) for r in sorted(token_counts.count_tokens(docs, model).collect(), key=key)]
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in sorted(docs.collect(), key=key)]
    assert got == want


@pytest.mark.parametrize("long", [1, 3, 17])
def test_parts_add_up_at_any_length(long):
    sp = token_counts.processor(vocabulary("piece_bpe_32k.model"))
    for text in texts():
        parts = list(token_counts.safe_pieces(text, long))
        assert sum(len(sp.encode(p)) for p in parts) == len(sp.encode(text)), text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, vocabulary("piece_bpe_32k.model")).count() == 0
    assert byte_bpe.round_trip(none, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0

"""Token counts of whole texts under a sentencepiece model."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import source

#: Characters above which a text is split, and bytes encoded at once.
LONG, BATCH = 1 << 14, 1 << 18


@functools.lru_cache(maxsize=2)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """Parts of a text whose token counts add up to that of the whole text.

    No piece of the model has the blank mark after another character, so no
    merge crosses the place between a non-blank and a following blank.  The
    text is cut there, and the blank itself is left out because the library
    puts one before each part.
    """
    at, end = 0, len(text)
    while end - at > long:
        cut = text.find(" ", at + long)
        while cut > 0 and (text[cut - 1] in " ▁" or cut + 1 == end):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def splittable(model: bytes) -> bool:
    """Whether safe_pieces holds for a model: blanks are marked in front, never stripped, never inside a piece."""
    sp = processor(model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    inner = any("▁" in p[1:] and p.strip("▁") for p in pieces)
    return not inner and sp.encode("a  b ") != sp.encode("a b") and sp.encode(" a") != sp.encode("a")


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row: UTF-8 bytes and tokens without special tokens.

    Null and empty texts count 0.  Only lengths leave the workers.  Parts of
    texts are encoded in batches of about equal bytes, however the lengths of
    the rows are spread; a model without safe boundaries gets whole texts.
    """
    rows = source(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    can_split = splittable(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            counts, parts, owners, held = [0] * batch.num_rows, [], [], 0

            def flush(parts: list[str], owners: list[int], counts: list[int]) -> None:
                for owner, ids in zip(owners, sp.encode(parts, num_threads=1), strict=True):
                    counts[owner] += len(ids)

            for i, text in enumerate(batch.column(1)):
                for part in safe_pieces(text.as_py()) if can_split else [text.as_py()]:
                    parts.append(part)
                    owners.append(i)
                    held += len(part.encode("utf-8", "surrogatepass"))
                    if held >= BATCH:
                        flush(parts, owners, counts)
                        parts, owners, held = [], [], 0
            flush(parts, owners, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, under fixed names; a null text is the empty text."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    Where none is named, a local session gets a temporary folder; any other
    session is refused, because its executors would not see each other's files.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes the rows once and cuts the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the rows of an Arrow batch from Spark's own 10,000, which are many for long texts; a session's other choice stays.

    Operators with Arrow functions set this for the session, since it is read
    when a query runs, not when it is written down.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, which bounds what a worker holds of long texts at a time."""
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


#: Bytes of computed rows up to which they are broadcast; beyond, both sides of a join are shuffled.
BROADCAST_BYTES = 8 << 20


def few(df: DataFrame) -> DataFrame:
    """``df``, marked to be broadcast if all its rows, measured as JSON, take at most BROADCAST_BYTES.

    Wants rows that are cheap to read twice, as those of ``kept`` and ``cut`` are.
    """
    wide = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return F.broadcast(df) if (df.agg(F.sum(wide + 32)).first()[0] or 0) <= BROADCAST_BYTES else df


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that stand for a row's id, which may be null, and text."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(7), doc_id, text).alias("k2")]


def sha256_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def kept(df: DataFrame) -> DataFrame:
    """Computes the rows once and cuts the lineage with a table in the shared folder, which goes when the session's JVM ends, or with ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.parquet(path)


@contextmanager
def noted() -> Iterator[list[str]]:
    """A list of the tables that this thread keeps meanwhile, in order."""
    before = _made.set(made := [])
    try:
        yield made
    finally:
        _made.reset(before)


@contextmanager
def settled(spark: SparkSession) -> Iterator[None]:
    """Of the tables that this thread keeps meanwhile, only the last stays; the others go at the end."""
    with noted() as made:
        yield
    drop(spark, made[:-1])
    if (before := _made.get()) is not None:
        before.extend(made[-1:])


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no rows are read from any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

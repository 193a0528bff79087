"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

#: A word is a run of bytes other than these (fixed value, also as a Java character class).
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Later uses do not compute it again, and the files survive lost executors.
    """
    path = shared_folder(df.sparkSession, f"{purpose}-{uuid.uuid4().hex[:8]}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of fixed-width keys that may be broadcast: some 30 MB.
BROADCAST_ROWS = 500_000


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """A written table of a few fixed-width columns, with a broadcast hint if it has no more than BROADCAST_ROWS
    rows. Beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct `_doc`, so that no other name can clash with theirs; `_doc.*` unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns, `_id` (never null) and `_hash`, that name a document by its content.

    Equal rows share a key, so a join on it neither loses nor mixes up rows where
    ids are null or repeated.
    """
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-1).cast("bigint")).alias("_id"),
        F.xxhash64(F.col(doc_id).isNull(), text_or_empty(text)).alias("_hash"),
    ]


#: Texts that a worker turns into Python objects at once.
TEXTS_AT_ONCE = 200


#: Rows of texts that Spark sends to Python in one batch, or reads from Parquet into one: a few MB instead of tens.
TEXTS_A_BATCH = 1_000


def text_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow and Parquet batches to TEXTS_A_BATCH rows, for tables whose rows hold whole texts.

    Spark reads the settings when a query runs, so they stay set; only memory and the size of batches depend on them.
    """
    conf = df.sparkSession.conf
    for setting in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(conf.get(setting)) <= TEXTS_A_BATCH:
            conf.set(setting, str(TEXTS_A_BATCH))


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column_of(batch: pa.RecordBatch, path: str | tuple[str, ...]) -> pa.Array:
    """A column, or a field within a struct column; so a text in a packed row is not sent to Python a second time."""
    name, *fields = (path,) if isinstance(path, str) else path
    column = batch.column(name)
    for field in fields:
        column = column.field(field)
    return column


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a text column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]

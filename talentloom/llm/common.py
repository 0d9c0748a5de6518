"""What several operators share: tables, text helpers, Arrow task loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(text: bytes) -> list[bytes]:
    """Maximal runs of anything but the six ASCII separators."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; other letters stay as they are."""
    return text.lower().split()


def width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def per_row(start: Callable[[], Callable[..., tuple | list[tuple] | None]], schema: pa.Schema, flush: int = 2000):
    """A mapInArrow function. `start()` runs once per task and returns a function of
    one row's values that gives one output tuple, a list of them, or None.

    Texts become Python strings one at a time, so a batch of very long texts does
    not exist twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, out = start(), []
        for batch in batches:
            for i in range(batch.num_rows):
                got = handle(*(column[i].as_py() for column in batch.columns))
                if isinstance(got, list):
                    out += got
                elif got is not None:
                    out.append(got)
                if len(out) >= flush:
                    yield to_batch(out, schema)
                    out = []
        if out:
            yield to_batch(out, schema)

    return run


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def own_columns(df: DataFrame, **columns) -> DataFrame:
    """Only the named columns, renamed, so other columns cannot clash with working names."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def checked_broadcast(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """`df` with a broadcast hint if its rows times `row_bytes` stay below `most`; beyond
    that Spark shuffles as for any join. Counts, so pass something written."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df

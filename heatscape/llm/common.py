"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatscape.session import scratch_folder, ship_package

#: Lower-cases A-Z and turns every ASCII byte that is no digit and no letter into a space; other bytes stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Characters of one slice of an Arrow batch, so that a task's memory does not follow the batch size.
SLICE_CHARS = 8_000_000


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to a new folder next to the checkpoints and read back, which cuts its lineage."""
    path = f"{scratch_folder(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """As ``kept``, in buckets of ``key``, so that joins and groups by it shuffle none of these rows."""
    spark = df.sparkSession
    name = f"llm_{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts in zstd take two thirds of the disk that the default takes
    df.write.bucketBy(n, key).option("path", f"{scratch_folder(spark)}/{label}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII digits, letters and non-ASCII characters."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def cuts(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive items that together have about ``limit``, one item at least."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts with about ``limit`` characters together, one text at least."""
    return cuts(list(map(len, texts)), limit)


def with_columns(df: DataFrame, text_col: str, fields: str, make: Callable[[], Callable[[list], list]],
                 limit: int = SLICE_CHARS, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` as struct ``row`` and columns made from the text.

    ``make()`` runs once a task and returns a function from a list of texts (null: empty)
    to one Arrow array or list for each of ``fields``, a DDL schema. The input's columns, or
    those named by ``columns``, are kept in the struct, so that their names can't clash with the new ones.
    """
    ship_package(df.sparkSession)
    own = T.StructType.fromDDL(fields)
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias("row"), text_or_empty(text_col).alias("text"))
    out = T.StructType([wide.schema["row"], *own.fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = [f.type for f in to_arrow_schema(own)]
    names = ["row", *own.names]

    def run(batches):
        columns_of = make()
        for batch in batches:
            texts = batch.column(1)
            for a, b in cuts(pc.utf8_length(texts).to_pylist(), limit):
                cols = columns_of(texts.slice(a, b - a).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], names=names)

    return wide.mapInArrow(run, out)


def unwrapped(df: DataFrame) -> DataFrame:
    """Only the input's columns of a frame made by ``with_columns``."""
    return df.select("row.*")


_held: dict = {}


def held(key: tuple, make: Callable):
    """What a Python worker keeps for its later tasks under ``key``; it lets go of what it kept for another operator.

    Workers go on from one operator to the next, so their remembered words would add up.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()


def doc_column(name: str = "doc_id") -> Column:
    return F.col(f"row.`{name}`").alias(name)

"""Helpers shared by the training-data operators.

Conventions of every operator here
----------------------------------
* Input is any DataFrame with an id and a text column; their names are parameters and all other columns
  are ignored, so extra columns can't clash with an operator's own names.
* A null text counts as an empty one. Null ids are ordinary values: they get a row like any other.
* Repeated rows are scored row by row; an operator whose result depends on other rows says how it orders them.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of a batch are handed on in slices of at most about this many bytes of text.
SLICE_BYTES = 8 << 20

ASCII_SPACE = b" \t\n\r\x0b\x0c"


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, mod ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it names none, as in tests, one in the
    warehouse, but only in local mode: elsewhere that may be a folder of one machine. Tables stay there until the folder
    is emptied, as a result may be computed again at any time."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from reliable storage: lost executors can't undo them."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's JVM collects their plans, which may be long after a step that
    needed much of the disk; this asks for it now."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table of their own in the shared folder. Columns that aren't read cost nothing."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    total = batch.column(batch.schema.get_field_index(text)).nbytes
    step = max(1, int(n * most / max(total, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, min(step, n - at))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_slices(frame: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], Iterator[list]], most: int = SLICE_BYTES) -> DataFrame:
    """``work`` over slices of a frame; it yields lists of equally long columns in the order of ``schema``."""
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, most):
                for out in work(batch):
                    columns = [
                        (v if v.type == f.type else v.cast(f.type)) if isinstance(v, pa.Array) else pa.array(v, type=f.type)
                        for f, v in zip(target, out, strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)
            pa.default_memory_pool().release_unused()  # workers live on and share their executor's memory

    return frame.mapInArrow(run, schema)


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    work: Callable[[pa.RecordBatch], Iterator[dict]],
    more: dict[str, Column] | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """``work`` over slices with the columns ``key``, ``text`` and those of ``more``.

    It yields dicts of equally long columns in the order of ``schema``, where {key} is the id's type.
    """
    frame = docs.select(
        F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"),
        *[c.alias(k) for k, c in (more or {}).items()],
    )

    def listed(batch: pa.RecordBatch) -> Iterator[list]:
        return (list(out.values()) for out in work(batch))

    return map_slices(frame, "text", schema.replace("{key}", dict(frame.dtypes)["key"]), listed, most)

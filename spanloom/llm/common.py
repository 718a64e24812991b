"""Shared plumbing of the training-data operators: reading tables, cutting lineage, splitting Arrow batches.

Nothing here is specific to one operator.  Python code works on Arrow batches and cuts them into pieces of a bounded
number of characters, so that memory does not depend on how long the texts of a batch are.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled at once inside a Python worker.
PIECE_CHARS = 2_000_000

_own_scratch: dict[str, str] = {}
_made: list[DataFrame] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``; a temporary one only for local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_scratch.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spanloom-"))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so later work does not depend on executors' local files."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _made.append(out)
    return out


def tidy(spark: SparkSession) -> None:
    """Collects garbage here and in the driver's JVM, upon which Spark removes the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def made() -> int:
    """How many tables have been written so far; for ``release_since``."""
    return len(_made)


def release_since(mark: int, but: DataFrame) -> None:
    """Removes what was written after ``mark``, but for ``but``: for callers that have written a final result."""
    for df in _made[mark:]:
        if df is not but:
            release(df)
    _made[mark:] = [but]


def release(df: DataFrame) -> None:
    """Removes a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def is_remainder(doc_id: str | Column, modulus: int, value: int) -> Column:
    """Whether a row is held out; rows without an id are not."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Row ranges of the batches holding at most ``limit`` bytes of text each, or one row, with their texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        sizes = pc.binary_length(column).to_pylist()
        for row, size in enumerate(sizes):
            if row > start and held + (size or 0) > limit:
                part = batch.slice(start, row - start)
                yield part, part.column(part.schema.get_field_index(text)).to_pylist()
                start, held = row, 0
            held += size or 0
        if batch.num_rows > start:
            part = batch.slice(start)
            yield part, part.column(part.schema.get_field_index(text)).to_pylist()


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def filter_rows(docs: DataFrame, verdicts: Callable[[], Callable[[list[str | None]], np.ndarray]], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes.  ``verdicts`` makes a task's own function from texts to booleans."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = verdicts()
        for batch, texts in pieces(batches, text):
            yield batch.filter(pa.array(np.asarray(passes(texts), bool)))

    return docs.select(*names).mapInArrow(run, docs.schema)

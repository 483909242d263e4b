"""What several operators share: null texts, shared-folder cuts, Arrow chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time; one longer text is handled whole.
CHUNK_BYTES = 1 << 20

#: Has a query's shuffle files deleted when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The whitespace that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset and the master is local, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='hedgerow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that a lost executor repeats nothing before it.

    The shuffle files of the writing go at once, as nothing reads them again.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text", field: str | None = None) -> Column:
    """The text, or that field of a struct, as a string; empty if it is null."""
    own = F.col(name) if field is None else F.col(name).getField(field)
    return F.coalesce(own.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(c: Column) -> Column:
    """The maximal runs without whitespace, in order."""
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often and wherever the body uses it.

    A column that a lambda uses can be computed again for each element, as the optimizer merges projections.
    """
    return F.get(F.transform(F.array(value), body), 0)


def window_hash(hashes: Column, start: Column, size: int) -> Column:
    """Hash of the ``size`` elements from ``start`` on, counted from 1; element by element, as a slice costs more than the hash."""
    return F.xxhash64(*[F.get(hashes, start + (k - 1)) for k in range(size)])


def crc32_of_id(name: str = "doc_id") -> Column:
    """Unsigned CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``limit`` bytes of text each, with their texts as UTF-8."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= limit:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def byte_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Like text_chunks, with the texts as one array of bytes and the places where each begins and the last ends."""
    for batch in batches:
        own = batch.column(column).cast(pa.large_binary())
        _, places, data = own.buffers()
        if not len(own):
            continue
        places = np.frombuffer(places, np.int64)[own.offset : own.offset + len(own) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        start = 0
        while start < len(own):
            stop = max(start + 1, int(np.searchsorted(places, places[start] + limit, side="right")) - 1)
            stop = min(stop, len(own))
            yield batch.slice(start, stop - start), data, places[start : stop + 1]
            start = stop

"""Small helpers of the operators: tables, staging and block sizes."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tollbook.session import fresh_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


WIDE_ROWS = {"parquet.block.size": str(4 * 1024 * 1024), "parquet.page.size.row.check.min": "1"}


def staged(df: DataFrame, label: str, by: str | None = None, wide: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors. ``wide`` rows may have
    megabytes each; they are written and read in row groups of a few, where else a task holds all rows of a file."""
    path = fresh_folder(df.sparkSession, label)
    writer = df.write.option("compression", "zstd").options(**WIDE_ROWS if wide else {})
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(amount: int | None, per_part: int, least: int = 1) -> int:
    """So many partitions that each gets about ``per_part`` of an amount."""
    return max(least, -(-int(amount or 0) // per_part))


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if it holds at most ``most`` (narrow) rows, else as it is, to be joined by shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with line marks added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 * 1024 * 1024


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, after its session was told to send Python at most 8 MB of rows (or one row) at once
    (64 MB by default); a smaller setting stays. Workers hold a batch several times over."""
    conf = df.sparkSession.conf
    now = conf.get(ARROW_BYTES).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return df


SLICE_BYTES = 4 * 1024 * 1024


def slices(batch, column: str, most: int = SLICE_BYTES):
    """A batch in slices whose texts (or numbers) in ``column`` have about ``most`` bytes, or that hold one row."""
    values = batch.column(column)
    listed = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    sizes = pc.multiply(pc.list_value_length(values), 4) if listed else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def released() -> None:
    """Leave a worker's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function of batches that leaves a worker's free memory to the system when its task ends: workers are
    kept for later tasks, and what each kind of task once needed would add up."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def added(df: DataFrame, fields: list, source: str, make, most: int = SLICE_BYTES) -> DataFrame:
    """Rows with further columns (in the place of columns of their names, in any case of letters): ``make`` gives
    them for the column ``source`` of a slice of a batch, which bounds what a worker holds."""
    from pyspark.sql import types as T

    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    column, used = source, df.select(*kept)
    if source.lower() in new:  # it is replaced, but has to be read
        column = free_name(df, "_source")
        used = df.select(*kept, df[source].alias(column))

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *make(part.column(column))], [*kept, *[f.name for f in fields]])

    return small_batches(used).mapInArrow(tidy(run), T.StructType([*[df.schema[c] for c in kept], *fields]))


CACHED_WORDS, CACHED_LENGTH = 150_000, 48


class Kept(dict):
    """Packed ids of words. When it is full, the older half goes."""

    def __init__(self, most: int | None = None):
        super().__init__()
        self.most, self.older = CACHED_WORDS if most is None else most, {}

    def missing(self, words) -> set[str]:
        """The words that have to be encoded; the others are there from now on."""
        new = words - self.keys()
        if len(self) + len(new) > self.most:
            self.older = dict(self)
            self.clear()
            new = words
        for word in new & self.older.keys():
            self[word] = self.older[word]
        return new - self.keys()

    def without_long(self, words) -> None:
        """Long words are not kept."""
        for word in words:
            if len(word) > CACHED_LENGTH:
                del self[word]

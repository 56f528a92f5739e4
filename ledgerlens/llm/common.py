"""Small helpers shared by the operators: stored intermediate tables in the
cluster's shared folder, and per-batch mapping of rows in Arrow tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path


#: Rows of an Arrow batch, at most.  Spark's default of 10,000 texts has no bound in
#: bytes that suits executors; the session's setting is lowered, never raised.
BATCH_ROWS = 1000
#: Bytes of a piece of a batch that :func:`map_rows` works on at once, unless a row has more.
PIECE_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: With this setting a query's shuffle files go when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage like ``checkpoint()`` (a lost executor costs no
    recomputation of what is stored), but is compressed, computed once, can be
    read by column, and carries its real size into the planner's join choice.
    The shuffles behind it are freed at once, since nothing reads them again.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, f"llm-{tag}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`store` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ledgerlens/llm-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


#: A stored table of at most so many short rows may be broadcast.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame) -> DataFrame:
    """A stored table of short rows as the build side of a join with large
    rows: broadcast if its counted rows are few, else the hashed side of a
    shuffle, so that the large rows are moved at most once and never sorted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that few texts are held twice.  At the end
    the worker, which goes on to serve other tasks, gives its free memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)
    release()


def halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``PIECE_BYTES``, or of one row."""
    if batch.num_rows <= 1 or batch.nbytes <= PIECE_BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half))
        yield from halved(batch.slice(half))


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # where the C library has it
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each input row, computed in Arrow tasks.

    ``make()`` runs once for each task and returns the row function, which may
    keep bounded state (caches) between rows; it gets the row's values and
    returns the output values.
    """
    spark: SparkSession = df.sparkSession
    bound_batches(spark)
    empty = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()

        def mapped(piece: pa.RecordBatch) -> pa.RecordBatch:
            rows = [fn(*r) for r in zip(*(c.to_pylist() for c in piece.columns))]
            cols = list(zip(*rows)) if rows else [()] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types)], schema=out)

        for batch in slices(batches):
            for piece in halved(batch):
                yield mapped(piece)              # its rows go before the next ones come
        del fn, mapped                           # with their caches, before the memory is given back
        release()

    return df.mapInArrow(run, schema)

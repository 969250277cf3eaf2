"""Helpers shared by the text operators: shared-folder tables, Arrow maps, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that an operator sends back, so that long texts stay small in memory,
#: and most rows of a batch that it gets.
OUT_ROWS, IN_ROWS = 512, 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (local sessions, as in tests) a temporary folder is made and set.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="kinescape-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinescape/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.__dict__["stored at"] = path  # not an attribute, which a column could have
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing reads any more."""
    for df in tables:
        if path := df.__dict__.get("stored at"):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``IN_ROWS`` rows, as whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= IN_ROWS:
        spark.conf.set(name, str(IN_ROWS))


def range_count(df: DataFrame, wide: int = 64 << 20) -> int:
    """Ranges to deal ``df`` by: the session's shuffle partitions, more where files hold over ``wide`` bytes for each."""
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    told = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a plan without statistics claims an absurd size
    return max(told, min(held, 1 << 60) // wide if held < 1 << 52 else 0)


def given_back() -> None:
    """Return what a task's texts and arrays held to the machine: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most ``IN_ROWS`` rows; a task's memory goes back at its end."""
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            given_back()

    return df.mapInArrow(task, schema)


def arrow_rows(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterable[dict[str, list]]]
) -> DataFrame:
    """``mapInArrow`` with ``work`` giving column dictionaries for each batch."""
    target = _arrow_schema(df.sparkSession, schema)
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [_array(columns[n], target.field(n).type) for n in names], schema=target
                )

    return mapped(df, run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def slices(batch: pa.RecordBatch, rows: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def crc_mod(column: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null stays null."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % parts


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long), by alternating star contraction.

    Returns node, component for every node that has an edge; the component is its smallest
    node. Each round is two aggregations and two written tables; neither edges nor labels reach
    the driver. Loops and null ends are ignored; repeated edges count once. The least
    neighbours are written before they are joined, so that the rows of a node with many
    neighbours can be split over tasks.
    """
    now = stored(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = stored(least.select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large star: every larger neighbour points at the least one
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        after = stored(small)
        told = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now, least)
        now = after
        if tuple(told) == mark:
            break
        mark = tuple(told)
    centres = now.select(F.col("v").alias("node")).distinct()
    return (
        now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        .unionByName(centres.select("node", F.col("node").alias("component")))
    )

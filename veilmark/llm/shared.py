"""Helpers shared by the operators: the shared folder, tables and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_OWN: list[str] = []
#: Bytes of a batch that a function in a worker gets at once.
PART_BYTES = 8 << 20
_NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
    pa.float32(): pd.Float32Dtype(), pa.float64(): pd.Float64Dtype(), pa.bool_(): pd.BooleanDtype(),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Only where that
    setting is absent on one machine (tests) a temporary folder is made; a cluster
    without it is an error, as its machines would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="veilmark-"))
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends there: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if f.startswith(shared_dir(spark)) or f.startswith(
                shared_dir(spark).replace("file://", "file:")
            ):
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which a long job with
    little work for the driver may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _give_back() -> None:
    """Returns a worker's freed memory to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives for ``key``, kept for this process's next tasks.

    Workers outlive their stages, so one thing is kept only: a large table of an earlier
    stage makes room for the next one's.
    """
    if key not in _HELD:
        _HELD.clear()
        _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``PART_BYTES``."""
    if len(batch):
        step = max(1, len(batch) * PART_BYTES // max(batch.nbytes, 1))
        for k in range(0, len(batch), step):
            yield batch.slice(k, step)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function gets batches of about ``PART_BYTES`` at any length of texts."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for b in batches for part in _parts(b))
        finally:
            _give_back()

    return df.mapInArrow(lean, schema)


def in_batches(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Like ``mapInPandas``, but in batches of about ``PART_BYTES`` and without loss.

    Numbers and booleans are pandas' nullable types: beside nulls, whole numbers keep
    all their digits, and NaN stays apart from null.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.to_pandas(types_mapper=_NULLABLE.get) for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=kind, preserve_index=False)

    return in_arrow(df, frames, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n`` (the folds of the contracts)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an undirected graph: rows (node, component).

    ``component`` is the smallest node id.  Alternating large-star and
    small-star steps: each is a minimum per node (combined before the shuffle)
    joined back to the edges, so a node with very many neighbours is only a
    skewed join key, which AQE splits.  A round ends in a table in the shared
    folder; the driver sees two numbers per round.  Self loops and null ends
    are ignored; nodes without edges don't appear.
    """
    a, b = F.col(src), F.col(dst)
    pairs = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now, seen = stash(pairs, "cc"), None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                        F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    )
                ).alias("e")
            )
            .select("e.u", "e.v").where("u != v").distinct()
        )
        then = stash(small, "cc")
        mark = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)

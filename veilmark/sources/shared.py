"""The folder that driver and executors share, and functions on Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_OWN: list[str] = []
#: Bytes of a batch that a function in a worker gets at once.
PART_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent on one machine (tests) a temporary folder is made; a
    cluster without it is an error, as its machines would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="veilmark-"))
    return _OWN[0]


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _parts(batch: pa.RecordBatch, part_bytes: int) -> Iterator[pa.RecordBatch]:
    if len(batch):
        step = max(1, len(batch) * part_bytes // max(batch.nbytes, 1))
        for k in range(0, len(batch), step):
            yield batch.slice(k, step)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, part_bytes: int = PART_BYTES) -> DataFrame:
    """``mapInArrow`` whose function gets batches of about ``part_bytes`` at any length of texts."""
    return df.mapInArrow(lambda batches: run(part for b in batches for part in _parts(b, part_bytes)), schema)

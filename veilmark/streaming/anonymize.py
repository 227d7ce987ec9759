"""Stateless anonymisation of a stream of text units or files.

Recognition and masking are one projection, so a stream needs no state or watermark;
file registries (order, continuations) are defined over finite folders and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilmark.operators.anonymize import anonymize_text
from veilmark.operators.rules import Rules
from veilmark.sources.files import decode_text

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files below a folder as they come: path, suffix, length, content."""
    raw = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_trigger).load(folder)
    )
    return raw.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def anonymized_text_files(spark: SparkSession, folder: str, rules: Rules | None = None) -> DataFrame:
    """(path, masked, entity_count, error) of text files as they come."""
    texts = decode_text(file_stream(spark, folder).where("suffix = '.txt'").drop("modificationTime"))
    return anonymize_text(texts, rules).select("path", "masked", "entity_count", "error")


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now, each file once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Token ids in Arrow stream files of equal-length sequences.

Each file is an Arrow IPC stream whose record batches hold two fixed-size lists
per row: ``ids`` (uint16 where the vocabulary allows, else uint32) and ``mask``
(false on the padding of the file's last sequence).  Fixed sizes make the place of
every token computable, so a reader maps the file and slices it without copying.
Documents follow each other in ascending doc_id order, within a file and from file
to file; an index table holds where each begins.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm.shared import in_batches, new_path, stash, table
from veilmark.llm.tokens import encoder, vocabulary

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SEQUENCE = 2048
#: Sequences of a record batch.
BATCH_ROWS = 64
#: Text of about so many characters goes into a file.
FILE_CHARS = 24_000_000
READ_CHARS = 4_000_000
#: Files are counted in runs of so many, so that no task orders all of them.
RUN_FILES = 1_000


class SequenceWriter:
    """Writes a stream of ids as rows of ``size`` into an Arrow stream file."""

    def __init__(self, sink: pa.NativeFile, size: int, wide: bool) -> None:
        self.size, self.kind = size, pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema(
            [("ids", pa.list_(self.kind, size)), ("mask", pa.list_(pa.bool_(), size))]
        )
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        flat = pa.array(ids.astype(self.kind.to_pandas_dtype()))
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.size) for x in (flat, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        full = self.size * BATCH_ROWS
        if self.held >= full:
            every = np.concatenate(self.rest)
            cut = len(every) // full * full
            for k in range(0, cut, full):
                self._put(every[k : k + full], full)
            self.rest, self.held = [every[cut:]], len(every) - cut

    def close(self) -> None:
        if self.held:
            every = np.concatenate(self.rest)
            self._put(np.pad(every, (0, -len(every) % self.size)), len(every))
        self.out.close()


class SequenceReader:
    """Random access to a file of :class:`SequenceWriter`, mapped where local."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        local = isinstance(fs, pafs.LocalFileSystem)
        source = pa.memory_map(path) if local else fs.open_input_file(path)
        batches = list(pa.ipc.open_stream(source))
        self.parts = [b.column(0).values.to_numpy() for b in batches]  # views of the file
        self.masks = [b.column(1).values for b in batches]
        self.starts = np.cumsum([0, *map(len, self.parts)])

    def __len__(self) -> int:
        """Tokens without the padding."""
        return sum(m.true_count for m in self.masks)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``; a view if they lie in one record batch."""
        k = int(np.searchsorted(self.starts, start, side="right")) - 1
        found = []
        while n > 0:
            part = self.parts[k][start - self.starts[k] : start - self.starts[k] + n]
            found.append(part)
            start, n, k = start + len(part), n - len(part), k + 1
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint16)


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, size: int = SEQUENCE,
    drops_space: bool = True,
) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into files under ``folder``.

    Returns the index, a table: file, part (its place in order), doc_id, start (in
    the file), n_tokens.  A null text counts as empty; every document ends with
    ``end_id``.  Rows repeating a doc_id are written in order of their text.  A
    task that runs again writes a file of another name, and the index names
    the files of the tasks that counted.  Null doc_ids come first.
    """
    path = path or vocabulary(VOCABULARY)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // FILE_CHARS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, drops_space)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.arrows"
        part, place, sink, writer, rows = TaskContext.get().partitionId(), 0, None, None, []
        for b in batches:
            texts, doc_ids = b["text"].fillna("").tolist(), b["doc_id"].tolist()
            if writer is None and texts:
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = SequenceWriter(sink, size, enc.tok.get_vocab_size() > 1 << 16)
            begin = 0
            while begin < len(texts):
                stop, room = begin, 0
                while stop < len(texts) and (stop == begin or room + len(texts[stop]) <= READ_CHARS):
                    room += len(texts[stop])
                    stop += 1
                ids, counts = enc.encode(texts[begin:stop])
                ends = np.cumsum(counts)
                writer.add(np.insert(ids, ends, end_id))
                for doc_id, n in zip(doc_ids[begin:stop], (counts + 1).tolist(), strict=True):
                    rows.append((name, part, doc_id, place, n))
                    place += n
                begin = stop
        if writer is not None:
            writer.close()
            sink.close()
            yield pd.DataFrame(rows, columns=["file", "part", "doc_id", "start", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    made = in_batches(ordered, run, f"file string, part int, doc_id {kind}, start long, n_tokens long")
    return stash(made, "token-index")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """Reads each document's ids back: doc_id, start (over all files), n_tokens,
    ids_crc32 (of unsigned 32-bit little-endian ids)."""
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("tokens")).withColumn(
        "run", F.floor(F.col("part") / RUN_FILES)
    )
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = files.groupBy("run").agg(F.sum("tokens").alias("tokens")).select("run", earlier(Window.orderBy("run")).alias("base"))
    within = files.withColumn("within", earlier(Window.partitionBy("run").orderBy("part")))
    offsets = within.join(runs, "run").select("file", (F.col("base") + F.col("within")).alias("before"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        fs, base = pafs.FileSystem.from_uri(folder)
        reader = SequenceReader(fs, f"{base}/{key[0].as_py()}")
        starts, counts = rows["start"].to_pylist(), rows["n_tokens"]
        crc = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, counts.to_pylist(), strict=True)]
        start = pc.add(rows["start"], rows["before"])
        return pa.table({"doc_id": rows["doc_id"], "start": start, "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())})

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.join(offsets, "file").groupBy("file").applyInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    index = write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(index, folder)

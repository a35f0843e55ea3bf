"""Flat token-id files: little-endian unsigned ids of 16 bits, or of 32 where the vocabulary needs them, with 64-bit document
offsets and keys beside them.

A data set is a folder of parts in document order and a manifest table (a Parquet folder). Each part has
`<part>.ids` (the ids), `<part>.off` (signed 64-bit: where each document begins in the part, then the part's length) and
`<part>.key` (signed 64-bit document ids). The manifest has a row for each part; its base, the number of ids before the part,
is a prefix sum over the parts; its width is that of an id in bytes. A task writes under a name of its own attempt, and only manifest rows of committed tasks
count, so a lost executor or a second attempt leaves files that nothing refers to.

Defined cases: a null or empty text is one end id; null ids come first and are kept as the least 64-bit number and read back
as null; repeated ids stay in text order; an empty table is a data set without parts; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, open_fs, released, task_tag, tokenizer_path
from .tokenize import encoder, in_slices

NO_ID = np.iinfo(np.int64).min
#: Ids that the reader takes at once.
READ_IDS = 1 << 20
MANIFEST = "part long, n_docs long, n_ids long, width int, name string"


def _write(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, name = encoder(path), f"part-{task_tag()}"
        fs, at = open_fs(folder)
        end, n_docs, n_ids = np.array([end_id], "<u4").tobytes(), 0, 0
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(at, recursive=True)
                out = [fs.open_output_stream(f"{at}/{name}.{x}", compression=None) for x in ("ids", "off", "key")]
            texts, keys = b.column("content").to_pylist(), b.column("key").fill_null(int(NO_ID)).to_numpy()
            for i, j in in_slices(texts):
                coded = [x + end for x in enc.encode(texts[i:j])]
                sizes = np.array([len(x) // 4 for x in coded], np.int64)
                ids = b"".join(coded)
                out[0].write(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids)
                out[1].write((n_ids + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                n_ids, n_docs = n_ids + int(sizes.sum()), n_docs + len(sizes)
            out[2].write(keys.astype("<i8").tobytes())
        if out is not None:
            out[1].write(np.array([n_ids], "<i8").tobytes())
            for f in out:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()), "width": pa.array([width], pa.int32()), "name": pa.array([name], pa.string())})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs in ascending id order to a new folder; the manifest is written last."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "content")
    parts = rows.mapInArrow(released(_write(path, end_id, f"{folder}/data")), MANIFEST)
    parts.repartition(1).write.parquet(f"{folder}/manifest")  # a row for each part


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each part, with its base: the ids of all parts before it. One row for each file, so the window is small."""
    from pyspark.sql import Window

    parts = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _mapped(fs, path: str, kind: str):
    """The file as an array: memory-mapped where it is local, else read on demand by ranges."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    file = fs.open_input_file(path)
    width = np.dtype(kind).itemsize

    class Ranges:
        def __getitem__(self, s: slice) -> np.ndarray:
            start, stop = s.start or 0, s.stop if s.stop is not None else file.size() // width
            return np.frombuffer(file.read_at((stop - start) * width, start * width), kind)

    return Ranges()


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = open_fs(folder)
        for b in batches:
            for name, n, base, width in zip(*(b.column(c).to_pylist() for c in ("name", "n_docs", "base", "width")), strict=True):
                ids, off, key = (_mapped(fs, f"{at}/{name}.{x}", k) for x, k in (("ids", f"<u{width}"), ("off", "<i8"), ("key", "<i8")))
                for i in range(0, n, 4096):
                    j = min(n, i + 4096)
                    at_ids, keys = np.array(off[i : j + 1]), np.array(key[i:j])
                    crcs = np.empty(j - i, np.int64)
                    for k in range(j - i):
                        crc = 0
                        for s in range(int(at_ids[k]), int(at_ids[k + 1]), READ_IDS):
                            crc = zlib.crc32(np.asarray(ids[s : min(s + READ_IDS, int(at_ids[k + 1]))]).astype("<u4").tobytes(), crc)
                        crcs[k] = crc
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, mask=keys == NO_ID), "start": pa.array(base + at_ids[:-1]), "n_tokens": pa.array(np.diff(at_ids)), "ids_crc32": pa.array(crcs)})

    return run


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: a row for each document with doc_id, start (ids before it in the data set), n_tokens and the CRC-32 of its ids as 32-bit numbers."""
    bounded_batches(spark)
    parts = manifest(spark, folder)
    return parts.repartition(max(1, spark.sparkContext.defaultParallelism) * 4, "name").mapInArrow(released(_read(f"{folder}/data")), "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A corpus is a folder of parts.  `part-K.bin` holds the ids of its documents
end to end, in the narrowest unsigned little-endian type that fits the
vocabulary; `part-K.idx` holds, as little-endian 64-bit integers, the number
of documents n and of those without an id, then n document ids (zero for the
first ones without an id), then n + 1 offsets in ids.  Parts are
ranges of ascending document id, so a part's base (the ids of all parts
before it) is the prefix sum of the parts' totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common, wordbpe

PART = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("documents", T.LongType()),
        T.StructField("tokens", T.LongType()),
    ]
)
READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One partition's files.  They are written under the attempt's own name and then moved, so that a repeated or
    speculative attempt leaves the same whole files."""
    from pyspark import TaskContext

    task = TaskContext.get()
    part, attempt = task.partitionId(), task.taskAttemptId()
    enc = wordbpe.encoder(tokenizer)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    fs, root = pafs.FileSystem.from_uri(folder)
    name = f"{root}/part-{part:06d}"
    temporary = f"{root}/_attempt-{part:06d}-{attempt}"
    ids: list[int | None] = []
    counts: list[np.ndarray] = []
    out = None
    for batch in common.rows(batches, "text"):
        if out is None:
            fs.create_dir(root, recursive=True)
            out = fs.open_output_stream(f"{temporary}.bin")
        encoded = enc.encode_many(batch.column("text").to_pylist())
        ids += batch.column("doc_id").to_pylist()
        counts.append(np.array([len(x) for x in encoded], dtype=np.int64) // enc.dtype.itemsize + 1)
        out.write(b"".join([y for x in encoded for y in (x, end)]))
    if out is None:
        return
    out.close()
    n = np.concatenate(counts)
    head = np.array([len(ids), ids.count(None)], dtype="<i8")  # those without an id come first
    keys = np.array([x or 0 for x in ids], dtype="<i8")
    offsets = np.concatenate([[0], np.cumsum(n)]).astype("<i8")
    with fs.open_output_stream(f"{temporary}.idx") as f:
        f.write(head.tobytes() + keys.tobytes() + offsets.tobytes())
    for kind in ("bin", "idx"):
        fs.move(f"{temporary}.{kind}", f"{name}.{kind}")
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": pa.array([len(ids)], pa.int64()), "tokens": pa.array([int(offsets[-1])], pa.int64())})


def _map(fs: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _read_part(batches: Iterator[pa.RecordBatch], folder: str, dtype: str) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
            name = f"{root}/part-{part:06d}"
            index = _map(fs, f"{name}.idx", "<i8")
            n, nameless = index[:2].tolist()
            keys, offsets = index[2 : n + 2], np.asarray(index[n + 2 :])
            ids = _map(fs, f"{name}.bin", dtype)
            for at in range(0, n, 20_000):
                stop = min(n, at + 20_000)
                bounds = offsets[at : stop + 1].tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(np.asarray(keys[at:stop]), mask=np.arange(at, stop) < nameless),
                        "start": pa.array(offsets[at:stop] + base),
                        "n_tokens": pa.array(np.diff(offsets[at : stop + 1])),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encodes every whole text, appends `end_id`, and writes the files in ascending id order under `folder`.

    Returns one row per part: part, documents, tokens, base.  Rows are dealt
    out by ranges of id, so no text meets more than one shuffle, and the bases
    are prefix sums over one row per part.  A null text is empty; a null id
    comes first and stays null; rows with one id keep the order of their
    texts; an empty table gives no part.  Other columns, whatever their names,
    are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or wordbpe.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = ordered.mapInArrow(partial(_write_part, folder=folder, tokenizer=tokenizer, end_id=end_id), PART)
    totals = sorted((r.part, r.documents, r.tokens) for r in done.collect())  # one small row per written file
    bases, base = [], 0
    for part, documents, tokens in totals:
        bases.append((part, documents, tokens, base))
        base += tokens
    schema = T.StructType([*PART.fields, T.StructField("base", T.LongType())])
    return spark.createDataFrame(bases, schema)


def read(parts: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, and the CRC-32 of its ids as
    little-endian unsigned 32-bit integers, all from the files."""
    dtype = wordbpe.encoder(tokenizer or wordbpe.default_path()).dtype.str
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select("part", "base").repartition(n).mapInArrow(partial(_read_part, folder=folder, dtype=dtype), READ)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' token ids to files in the shared folder and reads them back."""
    folder = common.new_dir(spark, "tokens")
    return read(write(common.table(spark, sf_dir, "documents"), folder), folder)

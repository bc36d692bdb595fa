"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 10_000  # texts may be long: Python workers get no larger Arrow batches, in rows and in bytes
BATCH_BYTES = 16 << 20
FILTER_BITS = 1 << 25
LOCAL_SHARED = "/tmp/checkpoints"  # only where spark.checkpoint.dir is unset and Spark runs in one process, as in tests
_LOCAL = threading.local()  # operators called from several threads of one driver never see each other's tables


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch where they are larger; smaller ones stay as the user set them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        value = re.fullmatch(r"(-?\d+)b?", str(spark.conf.get(name)).lower())
        if value and int(value[1]) not in range(1, most + 1):
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share. On a cluster spark.checkpoint.dir has to name it."""
    bounded_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


def _own() -> set[str]:
    """The folders of intermediate tables that this thread has written."""
    return _LOCAL.__dict__.setdefault("written", set())


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _own().add(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again.

    Survives lost executors, and later plans see the table's real size."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _own().discard(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table written by materialise() that no later plan reads; other files are never touched."""
    for path in {w for f in df.inputFiles() for w in _own() if f"/{w.rpartition('/')[2]}/" in f}:
        _delete(df.sparkSession, path)


def finished(df: DataFrame, tag: str, before: set[str]) -> DataFrame:
    """Write a result that is small against its input, and delete every intermediate table that is not in `before`."""
    out = materialise(df, tag)
    discard(df.sparkSession, before | {p for f in out.inputFiles() for p in _own() if f"/{p.rpartition('/')[2]}/" in f})
    return out


def discard(spark: SparkSession, before: set[str]) -> None:
    """Delete every intermediate table of this thread that is not in `before`."""
    for path in _own() - before:
        _delete(spark, path)


def written() -> set[str]:
    """This thread's folders of intermediate tables so far, for finished()."""
    return set(_own())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def may_be_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with a boolean `_may`, false only where df's long `column` is in no row of ids (one column of longs).

    One bit for each of FILTER_BITS hashes of ids, so what is broadcast is at most 4 MiB at any number of ids: with more
    ids more rows may, none is lost. Long rows that surely have no partner need no shuffle then."""
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS)) + 1
    at = place(F.col(ids.columns[0]))
    bits = ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    at = F.bitmap_bit_position(place(F.col(column))).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1
    marked = df.withColumn("_bucket", F.bitmap_bucket_number(place(F.col(column)))).join(F.broadcast(bits), "_bucket", "left")
    return marked.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(bit, F.lit(False)).alias("_may"))


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows that may be learnt from: crc32(doc_id as text) mod 4 is not 2."""
    return labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def bounded_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled documents, chosen by a hash of doc_id, one row each.

    Several labels of one document: the largest counts. Null labels are left out."""
    return (
        learnable(labels)
        .where(F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def byte_table(keep: bytes) -> bytes:
    """A translate() table: A-Z to a-z, bytes of `keep` and all bytes >= 0x80 stay, the rest is a space."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for b in keep:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


LETTERS = byte_table(bytes(range(0x61, 0x7B)))
ALNUM = byte_table(bytes(range(0x61, 0x7B)) + bytes(range(0x30, 0x3A)))
RAW = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))  # white space alone, letters as they are
SPACES = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))


def split_words(text: str | None, table: bytes | None = None) -> list[bytes]:
    """Lower-cased (A-Z) words: split at ASCII white space, or at all that `table` maps to a space."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(table) if table else raw.lower()).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an unsigned 64-bit array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PIECE = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """0 to n powers of an odd number modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, _BACK)):
            _POWERS[k] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, PIECE), base)])
    return _POWERS[0], _POWERS[1]


def run_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs values[start:stop] of mixed 64-bit values, by differences of one polynomial sum."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[stop] - total[start]) * down[start])


def word_spans(texts: pa.Array, table: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes through the table, flat, and their offsets; starts and stops of all words; words of each text.

    Words are what split_words() gives (null: none), found in the column's buffer without making them Python objects."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    low = np.frombuffer(table, np.uint8)[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]] if raw and len(texts) else np.zeros(0, np.uint8)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    inside = np.r_[False, low != 32, False]
    edge = np.zeros(len(low) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return low, at, start, stop, np.diff(np.searchsorted(start, at))


def span_hashes(low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of word_spans()."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # pieces of whole words, so that sums stay in the processor's cache
        j = max(int(np.searchsorted(stop, start[i] + PIECE, "right")), i + 1)
        a, z = start[i], stop[j - 1]
        out[i:j] = run_hashes(_BYTES[low[a:z]], start[i:j] - a, stop[i:j] - a)
        i = j
    return out


def word_hashes(texts: pa.Array, table: bytes = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, flat, and the number of words of each text (null: none)."""
    low, _, start, stop, n = word_spans(texts, table)
    return span_hashes(low, start, stop), n


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows` (but the last): for columns of fixed size."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

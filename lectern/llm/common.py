"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once: with it a batch of long texts stays within memory.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to `rows` and BATCH_BYTES, never raise it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception as error:  # an option of newer Spark versions
        if "CANNOT_MODIFY" not in str(error):
            raise


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session, as in tests, gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet into the shared folder and read it back.

    Lost executors then cost a reread, not a recomputation. The table goes when the session ends.
    """
    spark = session(df)
    path = f"{shared_folder(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that written() returned, once nothing reads them any more."""
    spark, path = session(df), getattr(df, "_lectern_path", None)
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """The columns named by their places, as Python workers take no column with a dot in its name."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n)


def fingerprint(text: Column) -> list[Column]:
    """Two independent 64-bit halves of a 128-bit text fingerprint."""
    return [F.xxhash64(text), F.xxhash64(F.lit("half"), text)]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array (nulls as empty) and its n + 1 offsets, without copying rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    flat = flat[offsets[0] : offsets[-1]] if len(offsets) else flat[:0]
    return flat, offsets - (offsets[0] if len(offsets) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and every non-ASCII byte are word characters.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_POWERS = np.ones(4096, np.uint64)
for _i in range(1, len(_POWERS)):
    _POWERS[_i] = np.uint64(int(_POWERS[_i - 1]) * _STEP & 0xFFFFFFFFFFFFFFFF)


def powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS[:n]
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, _STEP, np.uint64), out=out[1:])
    return out


def run_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs of bytes of the given sizes, some megabytes at a time."""
    ends = np.cumsum(size)
    out = np.empty(len(size), np.uint64)
    lo = 0
    while lo < len(size):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        own = size[lo:hi]
        first = ends[lo:hi] - own - base
        at = np.arange(int(own.sum()), dtype=np.int64)
        at -= np.repeat(first, own)
        with np.errstate(over="ignore"):
            terms = powers(int(own.max()))[at]
            terms *= _BYTE[data[base : base + len(at)]]
            out[lo:hi] = mix(np.add.reduceat(terms, first) + own.astype(np.uint64))
        lo = hi
    return out


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every lower-cased word of every text.

    Returns word hashes, the n + 1 offsets of each text's words, and each word's byte range in the
    concatenated texts. A word is a run of letters, digits and non-ASCII characters; texts are
    lower-cased first (unless `lower` is off), so a word hashes alike in any case.
    """
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    flat, off = buffers(pc.utf8_lower(texts) if lower else texts)
    n = len(flat)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), none, none
    inside = _WORD[flat]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = off[:-1][off[:-1] < n]
    before[first] = False  # a text's first byte starts a word of its own
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), none, none
    hashes = run_hashes(flat[inside], ends - starts)
    return hashes, np.searchsorted(starts, off).astype(np.int64), starts, ends


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text; a text of 1 to k - 1 words has one shingle of all its words."""
    counts = np.diff(off)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_off = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    total = int(out_off[-1])
    if not total:
        return np.zeros(0, np.uint64), out_off
    start = np.repeat(off[:-1], n) + np.arange(total) - np.repeat(out_off[:-1], n)
    end = np.repeat(off[1:], n)
    h = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            there = start + i < end
            w = words[np.minimum(start + i, len(words) - 1)]
            h = np.where(there, (h * np.uint64(0xD6E8FEB86659FD93)) + w, h)
        return mix(h), out_off


def ids_and_texts(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    return batch.column(0), batch.column(1)


def core(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that others, also ones with the names of results, play no part."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def local_tokenizer_path(name: str) -> str:
    """A tokenizer file: an absolute path, or a name looked up among the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

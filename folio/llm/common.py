"""Plumbing shared by the corpus operators: shared tables, Arrow text views, word and shingle hashes.

All hashing works on the UTF-8 bytes of whole Arrow batches with numpy, so no Python object is made
per word.  Block-shaped shuffles (one row per block and bucket, holding a packed array) keep the moved
bytes close to the information they carry.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None

#: Odd multipliers of the word and shingle hashes (any odd values do).
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset under a local master (tests)."""
    global _OWN_DIR
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return f"file://{_OWN_DIR}"


_SCOPE: str | None = None
_MADE: list[tuple[str | None, str, str | None]] = []


@contextmanager
def scope(name: str):
    """Tables that operators write meanwhile belong to `name`; release(name) removes them."""
    global _SCOPE
    before, _SCOPE = _SCOPE, name
    try:
        yield
    finally:
        _SCOPE = before


def release(spark: SparkSession, name: str, unless: DataFrame | None = None) -> None:
    """Remove the tables of a scope, but for those that `unless` still reads.

    Only a caller who knows that nothing else will read them again may ask for it.
    """
    read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in unless.inputFiles()} if unless is not None and any(x[0] == name for x in _MADE) else set()
    gone = [x for x in _MADE if x[0] == name and x[1].split(":", 1)[-1].lstrip("/") not in read]
    _MADE[:] = [x for x in _MADE if x not in gone]
    for _, path, table in gone:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, kind: str, buckets: int, column: str) -> DataFrame:
    """Write df as a table bucketed by a column in the shared folder; later joins on that column don't shuffle it."""
    spark = df.sparkSession
    name = f"folio_{kind}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _MADE.append((_SCOPE, path, name))
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    _MADE.append((_SCOPE, path, None))
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bound what one Arrow batch holds: 512 rows instead of 10,000, and 16 MB, which a single longer row may exceed."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: What a Python worker remembers from one task to the next, by owner.
WORKER_MEMORY: dict = {}


def forget() -> None:
    """Give back what other operators remember in this worker, before memory is needed for something else."""
    WORKER_MEMORY.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning (an int column, n partitions) deals to n different partitions, in their order."""
    found: dict[int, int] = {}
    most = 8 * n + 64
    while len(found) < n:  # about n * log(n) are looked at
        for r in spark.range(most).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(n)).alias("at")).groupBy("at").agg(F.min("label").alias("label")).collect():
            found[r["at"]] = r["label"]
        most *= 2
    return [found[k] for k in range(n)]


def range_of(col: Column, splits: list) -> Column:
    """Index of the range of `col` between sorted splits, by a binary search of conditions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col < F.lit(splits[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(splits))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty); columns that callers add, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column, nulls as empty, without copying the text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], type=col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


#: A-Z to a-z, all other bytes as they are; white space as [\x20\x09-\x0D].
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def doc_chunks(offs: np.ndarray, most: int = 1 << 20):
    """Ranges (i, j) of documents with at most `most` bytes together, or a single longer one."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words `[^\\x20\\x09-\\x0D]+` of all documents."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offs[(offs > 0) & (offs < n)]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[edges - 1] = solid[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [s, e), none empty, as numbers of 8 bytes, the last filled up with zeros; and where each begins."""
    size = (e - s + 7) >> 3
    first = np.cumsum(size) - size
    at = np.repeat(s - 8 * first, size) + 8 * np.arange(int(size.sum()), dtype=np.int64)
    view = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    x = view[at]
    end = first + size - 1
    x[end] &= _LOW_BYTES[e - s - 8 * (size - 1)]
    return x, first


#: Key of the word hash.
_KEY = np.uint64(0x2545F4914F6CDD1D)


def hash_eights(x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches in eights: every eight is mixed with its place before the sum, so no sum over places cancels out by construction."""
    with np.errstate(over="ignore"):
        place = np.arange(len(x), dtype=np.int64) - np.repeat(first, np.diff(np.append(first, len(x))))
        y = mix((x ^ _KEY) * MIX2 + mix(place.astype(np.uint64) * MIX1 + _KEY))
        return mix(np.add.reduceat(y, first) + length.astype(np.uint64) * MIX1) if len(first) else np.zeros(0, np.uint64)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each document, A-Z lower-cased.

    Returns hash, first byte and end byte of each word, and the word offsets of the documents.
    """
    s, e = word_bounds(data, offs)
    return hash_eights(*eights(LOWER[data], s, e), e - s), s, e, np.searchsorted(s, offs, "left")


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one document; fewer words make one shingle of all; no words, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        m = max(1, n - k + 1)
        out = np.full(m, min(n, k), np.uint64)
        mul = _powers(0xD6E8FEB86659FD93, k + 1)
        for j in range(min(n, k)):
            out += words[j : j + m] * mul[j + 1]
        return mix(out)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated stretches [start, start + len)."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)

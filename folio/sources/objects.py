"""A store of objects by key in a shared folder: writes through a Python data source with commit and abort, reads through a table of places.

A task appends its objects to one pack file and writes their places (key, type, offset, size) beside it; a commit names the packs of
a job.  So a hundred thousand keys are as many objects, but few files and no folder of their own.  What no commit names is not
there, so a lost task leaves nothing to see, and an aborted job's folders go.  The latest commit of a key holds; a deletion is a row
without content.

    folder/packs/<job>/<name>.pack      contents, one after another
    folder/places/<job>/<name>.parquet  key, content_type, at, size (null: deleted), pack, row
    folder/commits/<time>-<job>.json    one line a pack: {"pack": "<job>/<name>", "commit": time}
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of contents that one yielded batch holds when objects are fetched.
BATCH_BYTES = 16 << 20
_PLACES = "key string, content_type string, at long, size long, pack string, row long"


def _open(path: str):
    """(file system, path in it) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


@dataclass
class _Pack(WriterCommitMessage):
    name: str | None
    objects: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator) -> _Pack:
        import pyarrow.parquet as pq

        store, home = _open(self.path)
        name, at, row, sink, places = f"{self.job}/{uuid.uuid4().hex}", 0, 0, None, None
        pack, index = f"{home}/packs/{name}.pack", f"{home}/places/{name}.parquet"
        schema = pa.schema([("key", pa.string()), ("content_type", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("pack", pa.string()), ("row", pa.int64())])
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if sink is None:
                    sink, places = store.open_output_stream(pack), pq.ParquetWriter(index, schema, filesystem=store)
                starts, sizes = [], []
                for value in batch.column("content"):
                    raw = value.as_buffer() if value.is_valid else None
                    starts.append(at)
                    sizes.append(None if raw is None else raw.size)
                    if raw is not None:
                        sink.write(raw)
                        at += raw.size
                n = batch.num_rows
                places.write_table(pa.table([batch.column("key").cast(pa.string()), batch.column("content_type").cast(pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([name] * n), pa.array(range(row, row + n), pa.int64())], schema=schema))
                row += n
        finally:  # what fails or is killed is in the folders of a job that no commit names, and goes with them
            for f in (sink, places):
                if f is not None:
                    f.close()
        return _Pack(name if row else None, row)

    def commit(self, messages) -> None:
        store, home = _open(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        if not names:
            return self.abort(messages)
        now = time.time_ns()
        staged = f"{home}/staged-{self.job}"
        with store.open_output_stream(staged) as f:
            f.write("".join(json.dumps({"pack": n, "commit": now}) + "\n" for n in names).encode())
        store.move(staged, f"{home}/commits/{now}-{self.job}.json")

    def abort(self, messages) -> None:
        store, home = _open(self.path)
        for part in ("packs", "places"):
            store.delete_dir_contents(f"{home}/{part}/{self.job}", missing_dir_ok=True)
            try:
                store.delete_dir(f"{home}/{part}/{self.job}")
            except FileNotFoundError:
                pass


class ObjectStore(DataSource):
    """Writes (key, content, content_type) to the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return "folio_objects"

    def schema(self) -> str:
        return "key string, content binary, content_type string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("objects are replaced by key: append them")
        return _Writer(self.options["path"], self.options["job"])


# Content types by the ending of a key.
CONTENT_TYPES = {"md": "text/markdown", "json": "application/json", "png": "image/png", "pdf": "application/pdf", "txt": "text/plain", "zip": "application/zip"}


def content_type(key: Column) -> Column:
    """The type that a key's ending tells."""
    out = F.lit("application/octet-stream")
    for k, v in CONTENT_TYPES.items():
        out = F.when(F.lower(F.substring_index(key, ".", -1)) == k, v).otherwise(out)
    return out


def put(objects: DataFrame, path: str) -> None:
    """Write objects (key, content: binary or string, and content_type or what the key's ending tells).

    Of rows with one key in one job, any one holds.  Rows without a key are refused.
    """
    spark = objects.sparkSession
    spark.dataSource.register(ObjectStore)
    kind = F.coalesce(F.col("content_type"), content_type(F.col("key"))) if "content_type" in objects.columns else content_type(F.col("key"))
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    job = uuid.uuid4().hex
    for part in (f"packs/{job}", f"places/{job}", "commits"):
        where = spark._jvm.org.apache.hadoop.fs.Path(home, part)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    key = F.when(F.col("key").isNull(), F.raise_error("an object without a key")).otherwise(F.col("key"))
    objects.select(key.alias("key"), F.col("content").cast("binary").alias("content"), kind.alias("content_type")).write.format("folio_objects").option("job", job).mode("append").save(path)


def delete(keys: DataFrame, path: str) -> None:
    """Objects of these keys are gone; a key that isn't there counts as deleted too."""
    put(keys.select("key", F.lit(None).cast("binary").alias("content")), path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, content_type, size, written_at, pack, at) of what the store holds; contents are not read."""
    commits = spark.read.schema("pack string, commit long").json(f"{path}/commits")
    places = spark.read.schema(_PLACES).option("recursiveFileLookup", "true").parquet(f"{path}/places")
    latest = places.join(commits, "pack").groupBy("key").agg(F.max(F.struct("commit", "pack", "row", "content_type", "size", "at")).alias("o"))
    return latest.where("o.size IS NOT NULL").select("key", "o.content_type", "o.size", F.timestamp_micros(F.expr("o.commit div 1000")).alias("written_at"), "o.pack", "o.at")


def fetch(found: DataFrame, path: str) -> DataFrame:
    """Rows of a listing (and whatever columns came with them) with their content, each pack opened once a task."""
    columns, schema = found.columns, StructType([*found.schema.fields, StructField("content", BinaryType())])

    def run(batches):
        store, home = _open(path)
        name, source = None, None
        for b in batches:
            held, first, size = [], 0, 0
            for k, (pack, at, n) in enumerate(zip(b.column("pack").to_pylist(), b.column("at").to_pylist(), b.column("size").to_pylist(), strict=True)):
                if pack is None:
                    held.append(None)
                    continue
                if pack != name:
                    name, source = pack, store.open_input_file(f"{home}/packs/{pack}.pack")
                if held and size + n > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, k - first).columns, pa.array(held, pa.binary())], [*columns, "content"])
                    held, first, size = [], k, 0
                held.append(source.read_at(n, at))
                size += n
            yield pa.RecordBatch.from_arrays([*b.slice(first).columns, pa.array(held, pa.binary())], [*columns, "content"])

    return found.repartition("pack", F.expr(f"at div {64 << 20}")).sortWithinPartitions("pack", "at").mapInArrow(run, schema)


def get(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Keys (key, and other columns) with content_type and content, null where the store has none."""
    found = keys.join(listing(spark, path).select("key", "content_type", "size", "pack", "at"), "key", "left")
    return fetch(found, path).drop("size", "pack", "at")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, content_type, content) of all objects."""
    return fetch(listing(spark, path).select("key", "content_type", "size", "pack", "at"), path).drop("size", "pack", "at")


def exists(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The keys that the store holds."""
    return keys.join(listing(spark, path).select("key"), "key", "left_semi")

"""Table sources: Parquet tables of a folder, and folders of files read as documents."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only for a local master without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="folio-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what reads it more than once, or builds on it in rounds, begins there."""
    path = f"{work_dir(df.sparkSession)}/folio-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ingest(spark: SparkSession, path: str, glob: str = "*.pdf", least: int = 100, most: int = 50 << 20) -> DataFrame:
    """Binary files with their listing, a key each, and a status instead of an exception for bad sizes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    status = F.when(F.col("length") < least, "too_small").when(F.col("length") > most, "too_large").otherwise("stored")
    job = F.sha2(F.concat_ws(":", "path", F.col("length").cast("string")), 256)
    return files.select(job.alias("job_id"), F.format_string("temp/%s.pdf", job).alias("s3_key"), "path", "length", F.col("modificationTime").alias("last_modified"), status.alias("status"), "content")


def listing_older_than(spark: SparkSession, path: str, now: Column, hours: int) -> DataFrame:
    """Files not changed for `hours`, with their age; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    age = (F.unix_micros(now) - F.unix_micros("modificationTime")) / F.lit(3.6e9)
    return files.where(age > hours).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), age.alias("age_hours"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line; `#` begins a comment; blanks are dropped."""
    return spark.read.text(path).select(F.btrim(F.get(F.split("value", "#"), F.lit(0))).alias("entry")).where(F.col("entry") != "")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case terms, comment lines dropped."""
    return spark.read.text(path).select(F.lower(F.btrim("value")).alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result records; malformed ones become nulls instead of failing the read."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_results(df: DataFrame, path: str, key: str = "job_id", fmt: str = "json") -> None:
    """Results by a column of few values (a status); objects of their own keys go to folio.sources.objects."""
    df.write.mode("overwrite").partitionBy(key).format(fmt).save(path)


def existing(keys: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The keys that the folder holds."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.substring_index("path", "/", -1).alias("name"))
    return keys.join(there, F.substring_index("key", "/", -1) == F.col("name"), "left_semi")

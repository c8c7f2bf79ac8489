"""The object store: many keys in few files, the latest commit holds, aborted jobs and lost tasks leave nothing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.sources import objects


def test_many_keys_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    keys = spark.range(0, 100_000, numPartitions=4).select(F.format_string("results/%d/result.md", "id").alias("key"), F.concat(F.lit("# "), F.col("id").cast("string")).alias("content"))
    objects.put(keys, path)
    assert sum(1 for _ in Path(tmp_path).rglob("*")) < 30
    assert objects.listing(spark, path).count() == 100_000
    got = objects.get(spark, path, spark.createDataFrame([("results/7/result.md", 1), ("results/99999/result.md", 2), ("none", 3)], "key string, n int")).collect()
    assert sorted((r["n"], r["content_type"], bytes(r["content"]).decode() if r["content"] is not None else None) for r in got) == [(1, "text/markdown", "# 7"), (2, "text/markdown", "# 99999"), (3, None, None)]
    assert objects.read(spark, path).select(F.sum(F.octet_length("content"))).first()[0] == keys.select(F.sum(F.octet_length("content"))).first()[0]


def test_latest_holds_and_deletions(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda *x: spark.createDataFrame(list(x), "key string, content string, content_type string")
    objects.put(rows(("a", "one", None), ("b.json", "{}", None), ("c", "", "x/y")), path)
    objects.put(rows(("a", "two", "t/t")), path)
    objects.put(rows(), path)
    objects.delete(spark.createDataFrame([("b.json",), ("never",)], "key string"), path)
    held = {r["key"]: (r["content_type"], bytes(r["content"])) for r in objects.read(spark, path).collect()}
    assert held == {"a": ("t/t", b"two"), "c": ("x/y", b"")}
    assert [r["key"] for r in objects.exists(spark, path, spark.createDataFrame([("a",), ("b.json",)], "key string")).collect()] == ["a"]
    objects.put(rows(("b.json", "[]", None)), path)
    assert objects.exists(spark, path, spark.createDataFrame([("b.json",)], "key string")).count() == 1


def test_aborted_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    objects.put(spark.createDataFrame([("kept", "1")], "key string, content string"), path)
    before = sorted(p.name for p in Path(tmp_path).rglob("*") if not p.name.startswith("."))
    bad = spark.range(0, 4000, numPartitions=4).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 3999, F.raise_error(F.lit("broken"))).otherwise("x").cast("string").alias("content"))
    with pytest.raises(Exception, match="broken"):
        objects.put(bad, path)
    assert sorted(p.name for p in Path(tmp_path).rglob("*") if not p.name.startswith(".")) == before
    with pytest.raises(Exception, match="without a key"):
        objects.put(spark.createDataFrame([(None, "1")], "key string, content string"), path)
    assert [r["key"] for r in objects.listing(spark, path).collect()] == ["kept"]


def test_places_without_commit_are_not_there(spark, tmp_path):
    """A task that was lost after it wrote: its pack is in the folder, but no commit names it."""
    path = f"file://{tmp_path}/store"
    objects.put(spark.createDataFrame([("kept", "1")], "key string, content string"), path)
    objects.put(spark.createDataFrame([("lost", "2")], "key string, content string"), path)
    last = max((tmp_path / "store" / "commits").glob("*.json"))
    last.unlink()
    assert [r["key"] for r in objects.listing(spark, path).collect()] == ["kept"]


def test_large_objects_come_in_several_batches(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    objects.put(spark.range(0, 40, numPartitions=2).select(F.col("id").cast("string").alias("key"), F.repeat(F.col("id").cast("string"), 500_000).alias("content")), path)
    assert objects.read(spark, path).where(F.octet_length("content") == 500_000 * F.length("key")).count() == 40

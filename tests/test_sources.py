from pyspark.sql import functions as F

from folio.sources import tables


def test_ingest_and_listing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"x" * 200)
    (tmp_path / "b.pdf").write_bytes(b"tiny")
    (tmp_path / "c.txt").write_text("no")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in tables.ingest(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "stored", "b.pdf": "too_small"}
    later = F.expr("TIMESTAMP '2100-01-01'")
    assert tables.listing_older_than(spark, str(tmp_path), later, 24).count() == 3
    keys = spark.createDataFrame([("temp/a.pdf",), ("temp/z.pdf",)], "key string")
    assert [r["key"] for r in tables.existing(keys, spark, str(tmp_path)).collect()] == ["temp/a.pdf"]


def test_manifest_and_dictionary(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# all\na.pdf # first\n\n  b.pdf\n")
    assert sorted(r["entry"] for r in tables.manifest(spark, str(tmp_path / "m.txt")).collect()) == ["a.pdf", "b.pdf"]
    (tmp_path / "d.txt").write_text("# terms\nAlpha\nalpha\n beta \n")
    assert sorted(r["term"] for r in tables.dictionary(spark, str(tmp_path / "d.txt")).collect()) == ["alpha", "beta"]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("j1", "text one"), ("j2", "text two")], "job_id string, markdown string")
    tables.write_results(df, str(tmp_path / "r"))
    assert sorted(map(tuple, tables.json_results(spark, str(tmp_path / "r"), "markdown string, job_id string").select("job_id", "markdown").collect())) == [("j1", "text one"), ("j2", "text two")]


def test_images_without_data_are_skipped(spark):
    from folio.operators.stores import figure_objects

    df = spark.createDataFrame([("j1", "a", "QUJD"), ("j1", "b", ""), ("j1", "c", None), ("j2", "a", "data:image/png;base64,QUJD"), ("j2", "b", "data:image/png;base64,"), ("j2", "c", "no base64!")], "job_id string, ref_id string, image_base64 string")
    assert sorted((r["key"], bytes(r["content"])) for r in figure_objects(df, "job_id", "figures").collect()) == [("results/j1/figures/a.png", b"ABC"), ("results/j2/figures/a.png", b"ABC")]


def test_stored_tables_are_compressed_well(spark):
    from folio.sources.tables import stored

    got = stored(spark.range(10).selectExpr("id", "repeat('a', 50) AS t"), "test")
    assert all(f.endswith(".zstd.parquet") for f in got.inputFiles()) and got.count() == 10

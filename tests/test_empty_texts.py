import duckdb
import pytest
from pyspark.sql import functions as F

from folio.plans import registry
from tests.oracle import same

TEXTS = ["", None, " ", "\n", "\n\n", "\t\n", "a", "a\n", " a\n b \n", "a" * 40, "ab" * 60, "é" * 45, "x<!-- PAGE_BREAK -->y", "one two three\nfour five six seven eight nine ten"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of few characters or none, as a folder and as a view."""
    path = tmp_path_factory.mktemp("few")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(str(path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return str(path), c


@pytest.mark.parametrize("name", ["x07", "m01"])
def test_empty_texts(name, spark, tables):
    path, c = tables
    assert same(registry.queries()[name](spark, path), c, registry.oracles()[name])

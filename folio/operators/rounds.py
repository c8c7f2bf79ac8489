"""The structure model page after page, with the outline so far (E01, W01): rounds over a frontier.

Round k asks about the kth page of every document that has one, each with the headings that earlier pages gave; what is answered goes
into the documents' outlines for round k + 1.  A round is one job over all documents, begins at a written table, and takes only
documents that have further pages, so rounds are as many as the longest document has pages and their work adds up to the pages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.review import conversation_pages, structure_outline
from folio.plans.catalog import Catalog
from folio.sources.tables import stored, work_dir

CATALOG = Catalog()

ENTRY = "struct<level:int,text:string,page:int>"


def structure_rounds(pages: DataFrame, provider: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """All answers (key, page, error, headings) of a provider that is asked page by page.

    provider: from asks (key, page, the other columns of pages, outline array<struct<level,text,page>>) to answers (key, page, error, headings
    array<struct<level,text>>).  A page that fails, or isn't answered, adds nothing to the outline.
    """
    spark = pages.sparkSession
    w = W.partitionBy(key)
    x = stored(pages.withColumns({"__k": F.row_number().over(w.orderBy("page")), "__all": F.count("*").over(w)}), "asks")
    rounds = x.agg(F.max("__k")).first()[0] or 0
    home = f"{work_dir(spark)}/folio-answers-{uuid.uuid4().hex}"
    none = F.array().cast(f"array<{ENTRY}>")
    outlines = None
    schema = None
    for k in range(1, rounds + 1):
        asks = x.where(F.col("__k") == k)
        asks = asks.withColumn("outline", none) if outlines is None else asks.join(outlines, key, "left").withColumn("outline", F.coalesce("outline", none))
        answers = provider(asks.drop("__k", "__all")).select(key, "page", F.col("error").cast("string").alias("error"), F.col("headings").cast("array<struct<level:int,text:string>>").alias("headings"))
        schema = answers.schema
        answers.write.parquet(f"{home}/round={k}")
        if k < rounds:
            good = spark.read.schema(schema).parquet(f"{home}/round={k}").where("error IS NULL").select(key, F.transform("headings", lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"))).alias("headings"))
            longer = asks.where(F.col("__all") > k).join(good, key, "left")
            new = F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string>>")), lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), F.col("page").cast("int").alias("page")))
            outlines = stored(longer.select(key, F.concat("outline", new).alias("outline")), "outlines")
    if schema is None:
        schema = pages.select(key, "page", F.lit(None).cast("string").alias("error"), F.lit(None).cast("array<struct<level:int,text:string>>").alias("headings")).schema
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(home)


def last_level(asks: DataFrame) -> DataFrame:
    """A provider whose answer depends on what it was shown: one level below the last heading for a user's page, else the last one's level, up
    to three; level 1 at the beginning.  Every seventh (document and page) fails."""
    seen = F.get("outline", F.size("outline") - 1)["level"]
    level = F.when(seen.isNull(), 1).when(F.col("role") == "user", seen % 3 + 1).otherwise(seen)
    return asks.select("conv_id", "page", F.when((F.col("conv_id") + F.col("page")) % 7 == 0, "timeout").alias("error"), F.array(F.struct(level.cast("int").alias("level"), F.concat("role", F.lit(" "), F.col("page").cast("string")).alias("text"))).alias("headings"))


@CATALOG.add("e01_rounds", """
    WITH RECURSIVE p AS MATERIALIZED (SELECT conv_id, turn, turn + 1 AS page, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    r(conv_id, page, k, role, seen, level, failed) AS (
        SELECT conv_id, page, k, role, NULL::BIGINT, 1::BIGINT, (conv_id + page) % 7 = 0 FROM p WHERE k = 1
        UNION ALL
        SELECT conv_id, page, k, role, last, CASE WHEN last IS NULL THEN 1 WHEN role = 'user' THEN last % 3 + 1 ELSE last END, (conv_id + page) % 7 = 0
        FROM (SELECT p.*, CASE WHEN r.failed THEN r.seen ELSE r.level END AS last FROM r JOIN p ON p.conv_id = r.conv_id AND p.k = r.k + 1)
    )
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page) - 1 AS ord, page, level, role || ' ' || page AS text FROM r WHERE NOT failed
""")
def outlines_in_rounds(spark, sf_dir):
    """The outline when each page is asked about with what the pages before it gave."""
    pages = conversation_pages(spark, sf_dir)
    return structure_outline(pages, structure_rounds(pages, last_level, "conv_id"), "conv_id")

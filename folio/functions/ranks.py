"""Row numbers within groups of any size: a large group is cut into ranges of its order, ranges are numbered on their own, and offsets are added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.sources.tables import stored

#: Rows that one task sorts as a whole; groups of more are cut.
LARGE = 1 << 20


def numbered(df: DataFrame, key: str, order: list[str], name: str = "place", total: str = "total", large: int | None = None) -> DataFrame:
    """df with each row's number (from 1) in its group by `order`, whose first column is numeric, and the group's size.

    Groups of more than `large` rows are cut at quantiles of the first order column, which are written once, so every evaluation deals
    alike; rows with one value of it stay together.  What is joined is a row a group, or a row a range.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    large = LARGE if large is None else large
    w = W.partitionBy(key)
    sizes = df.groupBy(key).agg(F.count("*").alias(total))
    big = stored(sizes.where(F.col(total) > large).select(F.col(key).alias("__big")), "large")
    if big.isEmpty():
        return df.withColumns({name: F.row_number().over(w.orderBy(*order)), total: F.count("*").over(w)})
    inside = df.join(big, F.col(key).eqNullSafe(F.col("__big")), "left_semi")
    cuts = stored(inside.groupBy(F.col(key).alias("__cut")).agg(F.percentile_approx(order[0], [k / n for k in range(1, n)], 10_000).alias("__cuts")), "cuts")
    x = df.join(cuts, F.col(key).eqNullSafe(F.col("__cut")), "left")
    x = x.withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order[0]))), F.lit(-1))).drop("__cuts", "__cut")
    ranges = x.groupBy(key, "__range").agg(F.count("*").alias("__n"))
    ranges = ranges.select(F.col(key).alias("__key"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias(total))
    own = F.row_number().over(W.partitionBy(key, "__range").orderBy(*order))
    joined = x.withColumn("__own", own).join(ranges, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__range", "__key", "__r")

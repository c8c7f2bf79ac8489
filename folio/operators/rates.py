"""Counters and dashboards: increase over resets, rates with extrapolated edges, instant values with staleness, quantiles of bucket rates.

A sample is a row (labels, us, n, value); n orders samples of one time.  A counter falls only when it was reset, and then counts from 0.
What a window needs of a sample is its step from the one before, which is found within time buckets of a series and across them by
their last samples, so a series of any length spreads over tasks; windows are then sums with partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.telemetry import BOUNDS, events
from folio.plans.catalog import Catalog

CATALOG = Catalog()

MINUTE, HOUR = 60_000_000, 3_600_000_000
#: How far back an instant value is looked for.
LOOK_BACK = 5 * MINUTE


def counter_steps(samples: DataFrame, labels: list[str], bucket_us: int = 24 * HOUR) -> DataFrame:
    """samples with `step`: what the counter grew by since the sample before, 0 for a series' first; after a reset, its value."""
    of = F.expr(f"(us - pmod(us, {bucket_us})) div {bucket_us}")
    x = samples.withColumn("__of", of)
    w = W.partitionBy(*labels).orderBy("__of")
    ends = x.groupBy(*labels, "__of").agg(F.max_by("value", F.struct("us", "n")).alias("__end")).withColumn("__carried", F.lag("__end").over(w)).drop("__end")
    names = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in labels]
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in labels], F.col("__of").alias("__at"), "__carried")
    cond = F.col("__of") == F.col("__at")
    for c in names:
        cond = cond & c
    x = x.join(ends, cond)
    before = F.coalesce(F.lag("value").over(W.partitionBy(*labels, "__of").orderBy("us", "n")), F.col("__carried"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return x.withColumn("step", step.cast("double")).select(*samples.columns, "step")


def windows_of(us: Column, range_us: int, step_us: int) -> Column:
    """The evaluation times, multiples of the step, whose window (time - range, time] holds a sample."""
    first = F.expr(f"(us + {step_us - 1} - pmod(us + {step_us - 1}, {step_us})) div {step_us} * {step_us}")
    last = F.expr(f"(us + {range_us - 1} - pmod(us + {range_us - 1}, {step_us})) div {step_us} * {step_us}")
    return F.when(last >= first, F.sequence(first, last, F.lit(step_us)))


def rate(samples: DataFrame, labels: list[str], range_us: int, step_us: int) -> DataFrame:
    """(labels, at_us, rate): per-second rate of counters at multiples of the step, over the range before; windows of fewer than two samples
    have none.

    The increase between the window's first and last sample is carried on to its edges if they are near (1.1 times the samples' average
    distance), else by half that distance, and at the front not beyond where the counter would be 0.
    """
    # samples are added up in panes that windows consist of, so that windows copy panes, not samples
    pane = math.gcd(range_us, step_us)
    x = counter_steps(samples, labels).withColumn("pane", F.expr(f"(us + {pane - 1} - pmod(us + {pane - 1}, {pane})) div {pane} * {pane}"))
    x = x.groupBy(*labels, F.col("pane").alias("us")).agg(F.count("*").alias("k"), F.min(F.struct("us", "n", "value", "step")).alias("first"), F.max("us").alias("last"), F.sum("step").alias("steps"))
    x = x.withColumn("at_us", F.explode(windows_of(F.col("us"), range_us, step_us)))
    x = x.groupBy(*labels, "at_us").agg(F.sum("k").alias("k"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("steps").alias("steps")).where("k >= 2 AND last > first.us")
    x = x.withColumns({"increase": F.col("steps") - F.col("first.step"), "span": (F.col("last") - F.col("first.us")) / 1e6, "front": (F.col("first.us") - (F.col("at_us") - range_us)) / 1e6, "back": (F.col("at_us") - F.col("last")) / 1e6})
    mean = F.col("span") / (F.col("k") - 1)
    zero = F.when((F.col("increase") > 0) & (F.col("first.value") >= 0), F.col("span") * F.col("first.value") / F.col("increase"))
    front = F.least(F.col("front"), F.coalesce(zero, F.col("front")))
    near = lambda d: F.when(d < mean * 1.1, d).otherwise(mean / 2)
    return x.select(*labels, "at_us", (F.col("increase") * (F.col("span") + near(front) + near(F.col("back"))) / F.col("span") / (range_us / 1e6)).alias("rate"))


def instant(samples: DataFrame, labels: list[str], step_us: int, look_back_us: int = LOOK_BACK) -> DataFrame:
    """(labels, at_us, value): the last sample of each series at multiples of the step, unless it is older than the look-back."""
    x = samples.withColumn("at_us", F.explode(windows_of(F.col("us"), look_back_us, step_us)))
    return x.groupBy(*labels, "at_us").agg(F.max_by("value", F.struct("us", "n")).alias("value"))


def share(rates: DataFrame, part: Column) -> DataFrame:
    """(at_us, share): 100 times the summed rates of the part over all summed rates; null where those are 0."""
    all_ = F.sum("rate")
    return rates.groupBy("at_us").agg(F.when(all_ > 0, 100.0 * F.coalesce(F.sum(F.when(part, F.col("rate"))), F.lit(0.0)) / all_).alias("share"))


def quantile(bucket_rates: DataFrame, labels: list[str], q: float) -> DataFrame:
    """(labels, at_us, value): the quantile by rates of cumulative buckets (le: upper bound, null for no bound), by linear interpolation.

    The lowest bucket begins at 0 if its bound is over that; a quantile beyond the last bound is that bound; without an unbounded bucket, or
    with nothing counted, there is none.  Rates of higher buckets are never lower (small differences of windows are evened out).
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce("le", F.lit(float("inf"))).cast("double").alias("le"), F.col("rate").alias("r"))))
    x = bucket_rates.groupBy(*labels, "at_us", "le").agg(F.sum("rate").alias("rate")).groupBy(*labels, "at_us").agg(pairs.alias("b"))
    even = F.aggregate("b", F.array().cast("array<struct<le:double,r:double>>"), lambda a, v: F.array_append(a, F.struct(v["le"].alias("le"), F.greatest(v["r"], F.coalesce(F.get(a, F.size(a) - 1)["r"], v["r"])).alias("r"))))
    x = x.withColumn("b", even).withColumn("top", F.get("b", F.size("b") - 1))
    x = x.where((F.size("b") >= 2) & (F.col("top.le") == float("inf")) & (F.col("top.r") > 0)).withColumn("rank", q * F.col("top.r"))
    at = F.size(F.filter("b", lambda v: v["r"] < F.col("rank")))
    x = x.withColumn("i", F.least(at, F.size("b") - 1))
    here, before = F.get("b", F.col("i")), F.get("b", F.col("i") - 1)
    low, under = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["r"], F.lit(0.0))
    inside = F.when((F.col("i") == 0) & (here["le"] <= 0), here["le"]).otherwise(low + (here["le"] - low) * (F.col("rank") - under) / (here["r"] - under))
    return x.select(*labels, "at_us", F.when(F.col("i") == F.size("b") - 1, F.get("b", F.size("b") - 2)["le"]).otherwise(inside).alias("value"))


def drain(depths: DataFrame, rates: DataFrame) -> DataFrame:
    """(at_us, depth, seconds): summed depth of the queues, and how long it takes at the summed rate."""
    d, r = depths.groupBy("at_us").agg(F.sum("value").alias("depth")), rates.groupBy("at_us").agg(F.sum("rate").alias("rate"))
    return d.join(r, "at_us").select("at_us", "depth", (F.col("depth") / (F.col("rate") + 0.001)).alias("seconds"))


# --- counters of the events table: each begins anew every day --------------------------------------------------------------------------


def _counters(spark, sf_dir, labels: Column, name: str = "series") -> DataFrame:
    e = events(spark, sf_dir).select(labels.alias(name), "us", F.col("event_id").alias("n"), "value", F.to_date("ts").alias("day"))
    return e.select(name, "us", "n", F.row_number().over(W.partitionBy(name, "day").orderBy("us", "n")).cast("double").alias("value"))


_SAMPLES = "SELECT event_type AS series, epoch_us(ts) AS us, event_id AS n, CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE) AS value FROM events"


def rate_sql(samples: str, labels: str, range_us: int, step_us: int) -> str:
    """Rates in SQL from samples (labels, us, n, value)."""
    own = ", ".join(f"s.{c}" for c in labels.split(", "))
    return f"""
        SELECT {labels}, at_us, inc * (span + CASE WHEN front < mean * 1.1 THEN front ELSE mean / 2 END + CASE WHEN back < mean * 1.1 THEN back ELSE mean / 2 END) / span / {range_us / 1e6}::DOUBLE AS rate FROM (
            SELECT *, span / (k - 1) AS mean, least(front_, CASE WHEN inc > 0 AND fv >= 0 THEN span * fv / inc ELSE front_ END) AS front FROM (
                SELECT {labels}, at_us, k, fv, inc, (l - f) / 1000000::DOUBLE AS span, (f - at_us + {range_us}) / 1000000::DOUBLE AS front_, (at_us - l) / 1000000::DOUBLE AS back FROM (
                    SELECT {own}, at_us, count(*) AS k, min(us) AS f, max(us) AS l, arg_min(value, (us, n)) AS fv, sum(step) - arg_min(step, (us, n)) AS inc
                    FROM (SELECT *, CASE WHEN p IS NULL THEN 0::DOUBLE WHEN value < p THEN value ELSE value - p END AS step, unnest(range(CAST(ceil(us / {step_us}::DOUBLE) AS BIGINT) * {step_us}, us + {range_us}, {step_us})) AS at_us
                          FROM (SELECT *, lag(value) OVER (PARTITION BY {labels} ORDER BY us, n) AS p FROM ({samples}))) s
                    GROUP BY ALL HAVING count(*) >= 2 AND max(us) > min(us))))"""


_RATES = rate_sql(_SAMPLES, "series", 6 * HOUR, HOUR)


@CATALOG.add("g02_rate", _RATES)
def rates_of_counters(spark, sf_dir):
    return rate(_counters(spark, sf_dir, F.col("event_type")), ["series"], 6 * HOUR, HOUR)


@CATALOG.add("g01_instant", f"SELECT series, at_us, arg_max(value, (us, n)) AS value FROM (SELECT *, unnest(range(CAST(ceil(us / {HOUR}::DOUBLE) AS BIGINT) * {HOUR}, us + {2 * HOUR}, {HOUR})) AS at_us FROM ({_SAMPLES})) GROUP BY series, at_us")
def instants(spark, sf_dir):
    """G01 hourly, with a look-back of two hours."""
    return instant(_counters(spark, sf_dir, F.col("event_type")), ["series"], HOUR, 2 * HOUR)


@CATALOG.add("g03_rate", f"SELECT at_us, CASE WHEN sum(rate) > 0 THEN 100::DOUBLE * coalesce(sum(CASE WHEN series <> 'error' THEN rate END), 0) / sum(rate) END AS share FROM ({_RATES}) GROUP BY at_us")
def success_share(spark, sf_dir):
    return share(rates_of_counters(spark, sf_dir), F.col("series") != "error")


def _buckets(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    bounds = F.array(*[F.lit(float(b)) for b in BOUNDS], F.lit(None).cast("double"))
    x = e.select(F.col("event_type").alias("series"), "us", F.col("event_id").alias("n"), F.col("value").alias("v"), F.to_date("ts").alias("day"), F.explode(bounds).alias("le"))
    hit = F.coalesce((F.col("v") <= F.col("le")), F.lit(True)).cast("double")
    return x.select("series", "le", "us", "n", F.sum(hit).over(W.partitionBy("series", "le", "day").orderBy("us", "n").rowsBetween(W.unboundedPreceding, 0)).alias("value"))


_BUCKETS = f"SELECT event_type AS series, le, epoch_us(ts) AS us, event_id AS n, CAST(sum(CASE WHEN le IS NULL OR value <= le THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, le, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM events, (VALUES {', '.join(f'({b}::DOUBLE)' for b in BOUNDS)}, (NULL)) AS t(le)"


@CATALOG.add("g04_rate", f"""
    SELECT series, at_us, CASE WHEN i = len(les) THEN les[i - 1] WHEN i = 1 AND les[1] <= 0 THEN les[1] ELSE coalesce(les[i - 1], 0) + (les[i] - coalesce(les[i - 1], 0)) * (rank - coalesce(rs[i - 1], 0)) / (rs[i] - coalesce(rs[i - 1], 0)) END AS value
    FROM (SELECT *, 0.95::DOUBLE * rs[-1] AS rank, least(len(list_filter(rs, lambda r: r < 0.95::DOUBLE * rs[-1])) + 1, len(rs)) AS i FROM (
        SELECT series, at_us, list(le ORDER BY le) AS les, list(top ORDER BY le) AS rs FROM (SELECT series, at_us, le, max(rate) OVER (PARTITION BY series, at_us ORDER BY le) AS top FROM (SELECT series, at_us, coalesce(le, 'inf'::DOUBLE) AS le, rate FROM ({rate_sql(_BUCKETS, 'series, le', 12 * HOUR, 3 * HOUR)}))) GROUP BY series, at_us
    ) WHERE len(rs) >= 2 AND les[-1] = 'inf'::DOUBLE AND rs[-1] > 0)
""")
def quantile_of_rates(spark, sf_dir):
    """The 0.95 quantile of values over twelve hours, every three, from the rates of their buckets."""
    return quantile(rate(_buckets(spark, sf_dir), ["series", "le"], 12 * HOUR, 3 * HOUR), ["series"], 0.95)


@CATALOG.add("g05_rate", f"SELECT at_us, depth, depth / (rate + 0.001::DOUBLE) AS seconds FROM (SELECT at_us, sum(value) AS depth FROM ({CATALOG.oracles['g01_instant']}) GROUP BY at_us) JOIN (SELECT at_us, sum(rate) AS rate FROM ({_RATES}) GROUP BY at_us) USING (at_us)")
def drain_times(spark, sf_dir):
    return drain(instants(spark, sf_dir), rates_of_counters(spark, sf_dir))

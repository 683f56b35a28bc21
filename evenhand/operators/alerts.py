"""Severity gauges, alert rules, counters and request-rate checks."""

from pyspark.sql import DataFrame, Window as W, functions as F

CRITICAL_LEVEL = 3


def _epoch(column) -> F.Column:
    return F.unix_seconds(F.col(column))


def gauge_buckets(points: DataFrame, series, seconds: int = 60, at="end_time", gauge="gauge") -> DataFrame:
    """Largest gauge per series and time bucket."""
    bucket = F.floor(_epoch(at) / seconds).cast("long")
    return points.groupBy(*series, bucket.alias("bucket")).agg(F.max(gauge).alias("gauge"))


def immediate_alerts(points: DataFrame, series, seconds: int = 60) -> DataFrame:
    """Buckets in which a CRITICAL gauge was seen."""
    critical = points.where(F.col("severity") == "CRITICAL")
    return gauge_buckets(critical, series, seconds).where("gauge > 0")


def sustained_alerts(
    points: DataFrame, series, seconds: int = 60, hold: int = 300, level: int = CRITICAL_LEVEL
) -> DataFrame:
    """Runs of consecutive buckets above ``level`` that last ``hold`` seconds.

    Points are first reduced to one row per bucket, so a series has at most one
    row per minute here."""
    firing = gauge_buckets(points, series, seconds).where(F.col("gauge") > level)
    island = F.col("bucket") - F.row_number().over(W.partitionBy(*series).orderBy("bucket"))
    return (
        firing.withColumn("_island", island)
        .groupBy(*series, "_island")
        .agg(
            F.min("bucket").alias("first_bucket"),
            F.max("bucket").alias("last_bucket"),
            F.count(F.lit(1)).alias("buckets"),
        )
        .where(F.col("buckets") * seconds >= hold)
        .drop("_island")
    )


def running_counters(events: DataFrame, series, at="recorded_at") -> DataFrame:
    """Cumulative event count per series, one row per day."""
    daily = events.groupBy(*series, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("added"))
    upto = W.partitionBy(*series).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("total", F.sum("added").over(upto))


def rate_limit(
    requests: DataFrame, key: str, at: str, limit: int, seconds: int = 60
) -> DataFrame:
    """Requests per key in the window of ``seconds`` up to each instant, and whether
    they pass the limit. Refused requests count too.

    Time is cut into tiles as long as the window. An instant needs its own tile
    and the one before, so counts per instant are copied into the next tile and
    each tile is summed on its own: a hot key is spread over its tiles."""
    span = seconds * 1_000_000
    instants = requests.groupBy(key, F.unix_micros(at).alias("at_micros")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    tile = F.floor(F.col("at_micros") / span).cast("long")
    copies = F.array(
        F.struct(tile.alias("tile"), F.lit(True).alias("own")),
        F.struct((tile + 1).alias("tile"), F.lit(False).alias("own")),
    )
    window = W.partitionBy(key, "tile").orderBy("at_micros").rangeBetween(-(span - 1), 0)
    return (
        instants.select("*", F.inline(copies))
        .withColumn("in_window", F.sum("requests").over(window))
        .where("own")
        .withColumn("limited", F.col("in_window") > limit)
        .drop("tile", "own")
    )

"""Parquet table scans."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from evenhand.session import utc


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one Parquet table. Times without a zone are read as UTC."""
    df = utc(spark).read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Run parameterised SQL; parameters are bound, never pasted into the text."""
    return spark.sql(sql, args=params)


def day_partitions(start, end, column: str = "date"):
    """Predicate on the ``date`` partition column covering [start, end)."""
    return F.col(column).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))

"""Session helpers: the shared scratch folder and lineage cuts."""

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    A private temporary folder is only ever used on a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="evenhand-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has no lineage beyond the files, keeps column pruning, and
    carries true sizes, so later joins are planned on facts."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they
    need neither the driver's folder nor its PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(), "evenhand")  # the driver's own; Spark serves it
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))


def utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def sized_broadcast(df: DataFrame, label: str, max_rows: int = 200_000) -> DataFrame:
    """Write a per-key table once and mark it for broadcast if its row count allows.

    Beyond ``max_rows`` it is marked to join by shuffle, where adaptive execution
    splits hot keys. Unmarked, either side could still be broadcast: files are far
    smaller than their rows, and rows made by ``explode`` are not foreseen at all."""
    table = materialize(df, label)
    return F.broadcast(table) if table.count() <= max_rows else table.hint("merge")

"""Session settings, the shared work folder, and tables settled in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "eddyfield", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for settled tables: ``spark.checkpoint.dir``.

    A temporary folder stands in only in local mode, where every task sees it.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        base = shared
    elif context.master.startswith("local"):
        base = _local_dirs.get(context.applicationId)
        if base is None:
            base = _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/eddyfield-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside takes its shuffle files away when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, and it gives
    the planner the real size of the table: Spark then broadcasts it in a join when it
    is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_buckets(df: DataFrame, name: str, keys: list[str], grouped: bool = False, **options: str) -> DataFrame:
    """Settle ``df`` bucketed by ``keys``: later joins and aggregates on exactly these
    keys read it without a shuffle. One bucket per shuffle partition. Rows that are ``grouped`` by
    these keys are in their buckets and need no shuffle here. The options are those of the writer."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    placed = df if grouped else df.repartition(buckets, *keys)
    with _shuffles_removed(spark):
        (
            placed.write.bucketBy(buckets, *keys)
            .sortBy(*keys)
            .options(path=new_path(spark, name), **options)
            .saveAsTable(table)
        )
    return spark.table(table)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands at most ``rows`` rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``settle`` stored and that nothing reads any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if not files:  # an empty table without a file
        return
    folder = files[0].rsplit("/", 1)[0]
    if f"/eddyfield-{spark.sparkContext.applicationId}/" not in folder:
        raise ValueError("only settled tables can be discarded")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session set-up and the two helpers every multi-stage operator needs."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a hot key handled by one task before the key is salted.
HOT_ROWS = 65_536
#: Hot-key tables of at most this many rows may be broadcast; larger ones are joined by shuffle.
HOT_BROADCAST_ROWS = 100_000


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lorekiln")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes from which a table in fewer files than there are cores is spread over them.
SPREAD_BYTES = 2_000_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once. ``load`` and ``durable`` do so themselves."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        # made on the driver, from which Spark hands it to the workers
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-")) / package.name), "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory.

    A table of few files may hold its rows in fewer row groups than there are cores; it is spread over the cores by
    one shuffle of the columns that are used. Large tables have files enough and are read as they lie.
    """
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    few = int(str(size)) >= SPREAD_BYTES and len(rows._jdf.inputFiles()) < min(cores, 64)
    return rows.repartition(cores) if few else rows


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (context.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset a local session (tests) gets a temporary
    folder, and any other is refused, as its executors share none. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` on, Spark removes a checkpoint once nothing refers to it.
    """
    spark = df.sparkSession
    ship(spark)
    _shared_folder(spark)
    return df.checkpoint(eager=True)


def next_round(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Cut the lineage of one round of a loop by a table written to the folder of ``durable``; removes that of ``before``.

    A checkpoint keeps the size that the optimizer estimated, and a join multiplies sizes, so over rounds the estimate
    grows beyond all bounds and planning with it; a table has its true size.
    """
    spark = df.sparkSession
    ship(spark)
    at = f"{_shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    if before is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def hot_keys(rows: DataFrame, key: str, by: str, limit: int = HOT_ROWS, sample: int = 64) -> DataFrame | None:
    """Keys expected to hold more than ``limit`` rows, with the number of salts for each, or None.

    Counted on the rows whose hash of ``by`` falls in one of ``sample`` classes. The answer only steers how
    rows are spread over tasks; results are the same whatever it says.
    """
    least = max(2, limit // sample)
    hot = (
        rows.filter(F.pmod(F.xxhash64(F.lit("hot"), by), F.lit(sample)) == 0)
        .groupBy(key)
        .count()
        .filter(F.col("count") > least)
        .select(key, F.least(F.ceil(F.col("count") / least), F.lit(4096)).cast("int").alias("salts"))
    )
    hot = durable(hot)
    n = hot.count()
    if not n:
        return None
    return F.broadcast(hot) if n <= HOT_BROADCAST_ROWS else hot

"""Session helpers: tables, checkpoints in the cluster's shared folder, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SIZED_BROADCAST_ROWS = 200_000


def local_session(cores: str = "8", app: str = "isotrek") -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ISOTREK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # a round's checkpoint goes when nothing refers to it
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session: Spark sends the archive to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_isotrek_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="isotrek-ship-"), "isotrek_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._isotrek_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; choose a local one only in a local session that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="isotrek-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: reliable, no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _goes_at_exit(spark: SparkSession, place: str, make: bool = False) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if make:
        fs.mkdirs(path)
    fs.deleteOnExit(path)


def stored(df: DataFrame) -> str:
    """Write ``df`` as a compressed table into the shared checkpoint folder; its place. It goes when the session ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    _goes_at_exit(spark, place)
    return place


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table into the shared checkpoint folder and go on from there.

    For large results that are read more than once, where cut() would need several times the disk; the
    table goes when the session ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


def shared_folder(spark: SparkSession, name: str) -> str | None:
    """The path of a new folder in the shared checkpoint folder, if that is a local one; it goes when the session ends."""
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if not place.startswith(("file:", "/")):
        return None
    _goes_at_exit(spark, place, make=True)
    return "/" + place.removeprefix("file:").lstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a few large files would keep the others idle.

    Only rows of too few partitions are moved, so a table of many files is read where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

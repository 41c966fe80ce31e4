"""Sessions and tables."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package; on a cluster, install it or pass it by --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


#: Bytes of rows in memory for each byte of a compressed file.
UNPACKED = 50.0


#: Most bytes of a join's side that is broadcast without a hint. The driver holds a broadcast, in a table of pages several times its
#: rows' size, until its plan ends, and plans of the catalogue have up to a hundred joins.
MOST_SENT = "256k"


def sized(spark: SparkSession) -> SparkSession:
    """Tells the planner what compressed files come to in memory and what may go by way of the driver, unless the session says so itself.

    Sorted pixels and labels take a byte or less a row in Parquet. Without this a table of millions of rows passes for one of 10 MB
    and is broadcast by way of the driver; what is truly small AQE still broadcasts by its rows' size.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name, "1.0")) == 1.0:
        spark.conf.set(name, str(UNPACKED))
    name = "spark.sql.autoBroadcastJoinThreshold"
    if spark.conf.get(name) in ("10MB", "10485760", "10485760b"):
        spark.conf.set(name, MOST_SENT)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a directory."""
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def local(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: what spark.checkpoint.dir names, or the context's checkpoint folder.

    Only a local master without either gets a temporary folder; a cluster without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled so that those of equal keys are in one partition, for steps that go through partitions.

    A plain ``repartition`` by what a join below has dealt by is dropped by the planner, and if that join then turns into a broadcast,
    its shuffle is read where it lies: keys are torn apart. No join deals by a hash of its keys.
    """
    return rows.repartition(F.xxhash64(*keys))


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; results that were not written yet can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weft-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

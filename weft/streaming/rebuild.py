"""Results per image that follow their files: only images whose files are new, changed or gone are touched.

An image's signature covers its files' paths, lengths and times and the configuration. Results lie in a folder an image, and so do
signatures, in another table. Stale images are built and their folders replaced (dynamic partition overwrite), then their signatures:
after a failure in between they are stale still, and are built again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import discovery
from weft.session import stored

BUILT = "image_id string, signature string"


def listed(spark: SparkSession, folder: str, glob: str = "*", image: Column | None = None) -> DataFrame:
    """(image_id, path, length, time) of the files below a folder; contents are not read. image: of a path, its stem if not given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select((discovery.stem(F.col("path")) if image is None else image).alias("image_id"), "path", "length", F.col("modificationTime").alias("time"))


def signatures(files: DataFrame, config: str = "") -> DataFrame:
    """(image_id, signature) of each image's files, whatever their order."""
    one = F.concat_ws("|", "path", "length", F.unix_micros("time"))
    every = F.array_join(F.array_sort(F.collect_list(one)), "\n")
    return files.groupBy("image_id").agg(F.sha2(F.concat(every, F.lit(f"\n{config}")), 256).alias("signature"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(BUILT).parquet(path)
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BUILT)


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id").parquet(path)


def _drop(spark: SparkSession, path: str, images: list[str]) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for image in images:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"image_id={escape(image)}"), True)


def rebuild(spark: SparkSession, files: DataFrame, out: str, build: Callable[[DataFrame], DataFrame], config: str = "") -> dict:
    """Builds what is stale in ``out``/results: build(files of stale images) gives rows with image_id. Returns how many images were
    built, kept and removed.

    An image for which nothing is built has no rows, and older ones of it go.
    """
    now = stored(signatures(files.filter("image_id is not null"), config), "signatures")
    before = stored(_read(spark, f"{out}/signatures"), "signatures-before")
    stale = stored(discovery.stale(now, before), "stale")
    gone = [r[0] for r in before.join(now, "image_id", "left_anti").select("image_id").distinct().toLocalIterator()]
    many = stale.count()
    if many:
        rows = stored(build(files.join(stale.select("image_id"), "image_id", "left_semi")), "rebuilt")
        empty = stale.join(rows, "image_id", "left_anti").join(before, "image_id", "left_semi")
        _drop(spark, f"{out}/results", [r[0] for r in empty.select("image_id").distinct().toLocalIterator()])
        if not rows.isEmpty():
            _replace(rows, f"{out}/results")
        _replace(stale, f"{out}/signatures")
    # results go first: an image whose signature is left behind is found gone at the next time
    _drop(spark, f"{out}/results", gone)
    _drop(spark, f"{out}/signatures", gone)
    return {"built": many, "kept": now.count() - many, "removed": len(gone)}


def follow(spark: SparkSession, folder: str, out: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, config: str = "", glob: str = "*", every: str | None = None):
    """A stream that rebuilds whenever files arrive: what is there now, and then (``every`` so often) until it is stopped.

    Each batch compares the whole listing with the signatures, so that files which changed or went are found as well.
    """
    rebuild(spark, listed(spark, folder, glob), out, build, config)
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        rebuild(rows.sparkSession, listed(rows.sparkSession, folder, glob), out, build, config)

    writer = arriving.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

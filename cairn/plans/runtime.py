"""Table access, lineage cuts and size checks used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share: ``spark.checkpoint.dir``, or a fresh temporary one in local mode."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cairn-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_CUTS: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and go on from there: later reads prune columns and skip by statistics,
    and the loss of an executor costs nothing that was cut. release() deletes it early, the end of the session at last."""
    return counted_cut(df)[0]


def counted_cut(df: DataFrame, **sums) -> tuple[DataFrame, dict[str, float]]:
    """cut() with the sums of some columns over the rows written, observed by the same job.

    Tasks repeated after a loss may be counted again, so callers only ask whether a sum is 0.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    if not _CUTS:
        atexit.register(_release_all, spark)
    _CUTS.add(path)
    schema, seen = df.schema, {}
    if sums:
        watch = Observation()
        df.observe(watch, *[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in sums.items()]).write.parquet(path)
        seen = watch.get
    else:
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cairn_cut = path
    return out, seen


def release(*frames: DataFrame | None) -> None:
    """Delete the files of cuts that nothing will read again."""
    for df in frames:
        path = getattr(df, "_cairn_cut", None)
        if path in _CUTS:
            _CUTS.discard(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _release_all(spark: SparkSession) -> None:
    for path in list(_CUTS):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone: its folder is then its owner's to clean
            return
        _CUTS.discard(path)


def laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` and kept so: the joins of all rounds of a loop find one side in place, only the other
    moves. What an executor held is made again from what ``df`` was cut to. The caller unpersists."""
    n = conf_int(df.sparkSession, "spark.sql.shuffle.partitions", 200)
    return df.repartition(n, *keys).persist(StorageLevel.MEMORY_AND_DISK)


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key, str(default)))
    except ValueError:
        return default


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def salt(buckets: int, *cols: str) -> Column:
    """A deterministic salt of ``buckets`` values; the same after a retry, unlike rand()."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than there are; by a hash of ``key``, so that a retry gives
    the same parts. Inputs with at least as many partitions as cores stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)

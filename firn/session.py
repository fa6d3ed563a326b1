"""Session factory and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
#: Spark deletes a query's shuffle files at its end where this is set.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "firn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, adaptive execution and Arrow transfer."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder; elsewhere executors could not share one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="firn-")
    return _LOCAL_SCRATCH[app]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and read it back.

    Computed exactly once, columnar, and safe against executor loss; downstream
    plans see a plain scan with statistics instead of a growing lineage. The shuffle files
    behind it are deleted with the last task, as nothing can ask for them again.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.scratch_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` once nothing reads it any more."""
    _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, name: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete this application's own lineage-cut tables."""
    _delete(spark, f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

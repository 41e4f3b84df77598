"""Tables of a source folder, and scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterflux.shipping import ship

_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set: on one machine a temporary folder, on a cluster the warehouse, which all share."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and (current := sc._jsc.sc().getCheckpointDir()).isDefined():
        path = current.get()
    if not path:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        path = tempfile.mkdtemp(prefix="rasterflux-shared-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    # With the session's own settings, which an object store needs.
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What an application has written there is deleted when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/rasterflux/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_delete_at_exit, spark, _folders[app])
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors.

    ``discard`` deletes a table that nothing reads any more before the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialize`` returned; others are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)

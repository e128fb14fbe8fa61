"""Spark session helpers.

The library never creates a session implicitly; callers (tests, bench, the
driver) pass one in.  ``get_spark`` is a convenience for local runs that sets
the handful of knobs the jobs rely on (AQE, UTC session time zone, no UI).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "trajframe", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot does not JIT methods above 8000 bytes of bytecode; a whole-stage
        # method bigger than that would run interpreted.  Above this limit Spark
        # falls back to per-expression codegen, which the JIT does compile.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", os.environ.get("TRAJFRAME_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset (local tests) do we point it at a fresh
    scratch directory.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="trajframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back: its
    lineage ends there, and whatever uses it several times plans one scan each."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/trajframe-cut/{name}-{uuid.uuid4().hex}"
    untyped = [f.name for f in df.schema.fields if f.dataType.typeName() == "void"]
    kept = df.drop(*untyped)
    kept.write.parquet(path)
    return df.sparkSession.read.schema(kept.schema).parquet(path).withColumns({c: F.lit(None) for c in untyped}).select(*df.columns)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trajframe`` importable on the executors' Python workers (the
    per-episode pandas functions live in it): zip the package once, put it into the
    shared checkpoint folder by that folder's file system and ``addPyFile`` it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, f"trajframe-{app}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for root, _dirs, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        shared = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark), os.path.basename(path))
        shared.getFileSystem(conf).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(path), shared)
    spark.sparkContext.addPyFile(shared.toString())
    _SHIPPED.add(app)

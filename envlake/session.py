"""Session helpers: pinned settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings every envlake job relies on. Timestamps are UTC instants; intermediate files
# keep microseconds, and the lake writers switch to milliseconds for their own writes.
PINNED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # HotSpot does not JIT-compile methods over 8000 bytes; Spark's docs recommend this
    # limit so an over-sized fused stage (the wide health projection) falls back to
    # per-operator generated code, which is compiled, instead of running interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(master: str = "local[8]", app: str = "envlake", shuffle_partitions: int = 8,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with envlake's pinned settings. Used by tests and bench."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("ENVLAKE_DRIVER_MEMORY", "8g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # Local runs have tiny shuffles; a lower coalescing floor keeps all cores busy
         # (e.g. one writer task per few station-days instead of one for the whole lake).
         # Cluster-sized shuffles are far above this floor, so it only matters locally.
         .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k"))
    for k, v in {**PINNED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_pinned_conf(spark)
    return spark


def apply_pinned_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable pinned settings to an existing session."""
    for k, v in PINNED_CONF.items():
        try:
            spark.conf.set(k, v)
        except AnalysisException:  # static conf on a shared session: leave as configured
            pass


@contextmanager
def scoped_conf(spark: SparkSession, key: str, value: str):
    """Set a runtime SQL conf for the duration of a block (streaming queries started in
    the block keep it: they run on a clone of the session's conf)."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and is visible to every executor; it is
    read, never overridden. Only when it is unset in local mode (tests) is a folder
    created; on a cluster that is an error, as no local folder is shared.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="envlake-ckpt-")
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job's outputs."""
    return f"{checkpoint_root(spark)}/envlake-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df, name: str):
    """Write a frame to a fresh table under the shared folder and read it back: it is computed
    once, from the files its input listed, and no cache outlives the caller."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    with scoped_conf(spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme so Python-side helpers can address local test folders."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri



_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``envlake`` importable in executor Python workers (once per application).

    Functions run by ``mapInPandas``/``applyInPandasWithState`` are pickled by module
    reference, so executors need the package: it is zipped on the driver and added with
    ``addPyFile``, which distributes it to every executor, including ones started later.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    zdir = tempfile.mkdtemp(prefix="envlake-pyfiles-")
    zpath = os.path.join(zdir, "envlake.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(app)

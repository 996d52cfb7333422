"""The Hive-partitioned Parquet lakes: ``station=/year=/month=/day=/flush=/`` for readings
and a sibling ``{root}-health`` lake (``station=/year=/month=/day=/``) for device health.

``flush`` names who wrote a file: ``batch`` for batch jobs, which append, or a streaming query and
its micro-batch, which replaces what an earlier attempt of itself wrote. So a scan is a plain listing
of folders that sees stream and batch files alike; no log decides what counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envlake.functions.dtypes import canonical_dtypes
from envlake.functions.station_id import split_station_ids
from envlake.session import scoped_conf
from envlake.schema import (HEALTH_COLUMNS, HEALTH_FILE_SCHEMA, SENSOR_FILE_SCHEMA, SENSOR_LAKE_SCHEMA)

PARTITION_COLUMNS = ["station", "year", "month", "day"]
FLUSH_COLUMN = "flush"
BATCH_FLUSH = "batch"
CODECS = ("zstd", "snappy", "gzip", "none", "uncompressed", "lz4")


def health_root(readings_root: str, health_dir: str | None = None) -> str:
    """Health lake root: ``{readings_root}-health`` unless set explicitly."""
    if health_dir and health_dir not in ("", "."):
        return health_dir
    return readings_root.rstrip("/") + "-health"


def _write(df: DataFrame, root: str, data_cols: list[str], compression: str, mode: str, more: tuple[str, ...] = ()) -> None:
    if compression not in CODECS:
        raise ValueError(f"unsupported codec {compression!r}")
    missing = [c for c in PARTITION_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"partition values missing: {missing}; see batch_partition_values")
    present = [c for c in data_cols if c in df.columns]
    out = df.select(*present, *PARTITION_COLUMNS, *more)
    # REBALANCE lets AQE coalesce small station-days and split a hot one, so one
    # writer task per directory-sized chunk; rows are time-sorted for tight statistics.
    # The lake stores millisecond timestamps, like the reference's files.
    with scoped_conf(df.sparkSession, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MILLIS"):
        (out.hint("rebalance", *PARTITION_COLUMNS)
            .sortWithinPartitions(*PARTITION_COLUMNS, "timestamp")
            .write.mode(mode).partitionBy(*PARTITION_COLUMNS, *more)
            .option("compression", compression).option("partitionOverwriteMode", "dynamic")
            .parquet(root))


def write_readings(df: DataFrame, root: str, compression: str = "zstd", mode: str = "append",
                   quarantine: str | None = None, flush: str = BATCH_FLUSH) -> None:
    """Write sensor readings. Needs ``station`` and batch-level ``year/month/day``
    (zero-padded strings, from ``batch_partition_values``); ``station_id`` never enters a
    file. Measurements are stored as float32 and timestamps in milliseconds. With a
    ``quarantine`` folder, rows whose ``station`` is no valid id are written there as they are,
    and the lake gets the canonical ids. ``mode='overwrite'`` replaces, of the days written, what the
    same ``flush`` wrote before."""
    d = df.drop("station_id") if "station_id" in df.columns else df
    if quarantine:
        d, refused = split_station_ids(d)
        refused.withColumn(FLUSH_COLUMN, F.lit(flush)).write.mode(mode).partitionBy(FLUSH_COLUMN).option(
            "compression", compression).option("partitionOverwriteMode", "dynamic").parquet(quarantine)
    d = canonical_dtypes(d).withColumn(FLUSH_COLUMN, F.lit(flush))
    _write(d, root, [f.name for f in SENSOR_FILE_SCHEMA.fields], compression, mode, (FLUSH_COLUMN,))


def write_health(df: DataFrame, root: str, compression: str = "zstd", mode: str = "append") -> None:
    """Write health records (the 22 health columns) to the health lake."""
    d = df.drop("station_id") if "station_id" in df.columns else df
    cols = [F.col(n).cast(t).alias(n) if n in d.columns else F.lit(None).cast(t).alias(n)
            for n, t in HEALTH_COLUMNS]
    d = d.select(*cols, *PARTITION_COLUMNS)
    _write(d, root, [n for n, _ in HEALTH_COLUMNS], compression, mode)


def partition_paths(root: str, stations: Iterable[str] | None = None,
                    dates: Iterable[tuple[int, ...]] | None = None) -> list[str]:
    """Directories to list for a scan narrowed to stations and/or dates, each a day (y, m, d), a month
    (y, m) or a year (y,).

    Listing only these directories keeps file discovery proportional to the query's
    scope on a lake with tens of millions of files."""
    root = root.rstrip("/")
    st = [f"station={s}" for s in stations] if stations else ["station=*"]
    if not stations and not dates:
        return [root]
    if not dates:
        return [f"{root}/{s}" for s in st]
    names = ("year={:04d}", "month={:02d}", "day={:02d}")
    return ["/".join([root, s, *(n.format(v) for n, v in zip(names, date))]) for s in st for date in dates]


def _scan(spark: SparkSession, schema, root: str, stations, dates) -> DataFrame:
    paths = partition_paths(root, stations, dates)
    if stations or dates:
        # a narrowed scan may name days without data; keep only directories that exist
        from envlake.sources.files import any_match
        paths = [p for p in paths if any_match(spark, p)]
        if not paths:
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root.rstrip("/")).parquet(*paths)


def scan_readings(spark: SparkSession, root: str, stations: Iterable[str] | None = None,
                  dates: Iterable[tuple[int, ...]] | None = None) -> DataFrame:
    """Scan the sensor lake with partition columns from the path.

    The schema is explicit (no per-file inference over many small files); columns a
    file lacks read as NULL. Filters on station/year/month/day prune partitions.
    """
    return scan_flushes(spark, root, stations, dates).drop(FLUSH_COLUMN)


def scan_flushes(spark: SparkSession, root: str, stations: Iterable[str] | None = None,
                 dates: Iterable[tuple[int, ...]] | None = None) -> DataFrame:
    """:func:`scan_readings` with the column ``flush``."""
    return _scan(spark, T.StructType([*SENSOR_LAKE_SCHEMA.fields, T.StructField(FLUSH_COLUMN, T.StringType())]), root, stations, dates)


__all__ = ["write_readings", "write_health", "scan_readings", "scan_flushes",
           "health_root", "partition_paths", "PARTITION_COLUMNS", "HEALTH_FILE_SCHEMA"]

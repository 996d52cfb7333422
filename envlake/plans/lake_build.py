"""Builds the sensor and health lakes from the test tables once per session and folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from envlake.operators.batching import health_partition_values
from envlake.operators.health import normalize_health, power_status
from envlake.plans.collect import corrected_readings, lake_readings
from envlake.session import materialise, work_dir
from envlake.sources import fixtures as fx
from envlake.sources.lake import health_root, write_health, write_readings


@dataclass(frozen=True)
class Lakes:
    readings: str
    health: str


def health_records(spark: SparkSession, sf: str, corrected: DataFrame | None = None) -> DataFrame:
    """Health records taken at the sampled readings, with the batch-level partition
    values of the batch each sample was flushed with."""
    c = corrected if corrected is not None else corrected_readings(fx.raw_readings(spark, sf))
    samples = c.where("health_sample").select("station", "event_id", "boot_id", "batch_end")
    raw = fx.raw_health(spark, sf).drop("boot_id").join(samples, on=["station", "event_id"], how="inner")
    # fold only the supplies of sampled readings (semi join before the aggregate)
    power = fx.raw_power(spark, sf).join(samples.select("station", "event_id"),
                                         on=["station", "event_id"], how="left_semi")
    h = normalize_health(raw, power_status(power), keep=("station", "boot_id", "batch_end"))
    return health_partition_values(h, c)


_BASE: dict[tuple[str, str], str] = {}
_DONE: set[tuple[str, str, str]] = set()


def _base(spark: SparkSession, sf: str) -> str:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BASE:
        _BASE[key] = work_dir(spark, "lake") + "/output"
    return _BASE[key]


def readings_lake(spark: SparkSession, sf: str, compression: str = "zstd") -> str:
    """Write the readings lake once per application and test-table folder; its root."""
    root = _base(spark, sf)
    key = (spark.sparkContext.applicationId, sf, "readings")
    if key not in _DONE:
        write_readings(lake_readings(corrected_readings(fx.raw_readings(spark, sf))), root,
                       compression=compression)
        _DONE.add(key)
    return root


def health_lake(spark: SparkSession, sf: str, compression: str = "zstd") -> str:
    """Write the health lake (sibling ``-health`` root) once; its root."""
    hroot = health_root(_base(spark, sf))
    key = (spark.sparkContext.applicationId, sf, "health")
    if key not in _DONE:
        write_health(health_records(spark, sf), hroot, compression=compression)
        _DONE.add(key)
    return hroot


def build_lakes(spark: SparkSession, sf: str, compression: str = "zstd") -> Lakes:
    """Write both lakes from one corrected plan (memoised per application and folder)."""
    app = spark.sparkContext.applicationId
    root = _base(spark, sf)
    hroot = health_root(root)
    todo = [w for w in ("readings", "health") if (app, sf, w) not in _DONE]
    if todo:
        # both lakes read the corrected rows: written once to the shared folder
        corrected = materialise(corrected_readings(fx.raw_readings(spark, sf)), "corrected")
        if "readings" in todo:
            write_readings(lake_readings(corrected), root, compression=compression)
            _DONE.add((app, sf, "readings"))
        if "health" in todo:
            write_health(health_records(spark, sf, corrected), hroot, compression=compression)
            _DONE.add((app, sf, "health"))
    return Lakes(root, hroot)


__all__ = ["build_lakes", "readings_lake", "health_lake", "health_records", "Lakes"]

"""Health lake scan that tolerates per-file type drift.

Health files are written without a fixed schema: an all-NULL metric is stored as a
Null-typed column and a metric may be INT64 in one file and DOUBLE in another. Spark's
Parquet reader cannot read such files with one schema (``mergeSchema`` fails, and an
explicit STRING/DOUBLE schema fails on INT32-Null and INT64 columns).

So file footers are read in a Spark job first (tasks open only the footer), and the files are grouped by
what their columns are stored as. Each group is one native scan with its own types, cast to the canonical
ones, and the scans are joined in a union; filters on partitions and columns reach every scan. A group of
the canonical types is named by the largest folders that hold nothing else, the others by their files.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envlake.schema import HEALTH_COLUMNS, PARTITION_SCHEMA
from envlake.session import materialise, ship_package
from envlake.sources.files import _fs, _join, any_match, list_files, qualified
from envlake.sources.lake import partition_paths

_ARROW_TO_SPARK = {
    "null": T.NullType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(),
    "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(),
    "uint32": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "halffloat": T.FloatType(),
    "string": T.StringType(), "large_string": T.StringType(),
}


def _spark_type(arrow_type: str) -> T.DataType:
    if arrow_type.startswith("timestamp"):
        return T.TimestampType()
    if arrow_type in _ARROW_TO_SPARK:
        return _ARROW_TO_SPARK[arrow_type]
    raise ValueError(f"unsupported health column type {arrow_type}")


def stored_types(columns: list[tuple[str, str]]) -> str:
    """The health columns of a footer that aren't stored in their canonical type, as ``name type, ...``;
    empty for a canonical file. A column without values (Arrow's null) is ``void``."""
    target = dict(HEALTH_COLUMNS)
    kinds = [(name, _spark_type(t)) for name, t in columns if name in target]
    return ", ".join(f"{name} {t.simpleString()}" for name, t in sorted(kinds, key=lambda x: x[0]) if t != target[name])


def footer_kinds(files: DataFrame, root: str) -> DataFrame:
    """``(path, folder, kind)`` per root-relative file path, with :func:`stored_types` as the kind. Footers are
    read in executor tasks."""
    ship_package(files.sparkSession)
    root = qualified(files.sparkSession, root)

    def run(batches):
        import pyarrow.parquet as pq
        fs, base = _fs(root)
        for pdf in batches:
            kinds = []
            for p in pdf["path"]:
                with fs.open_input_file(_join(base, p)) as f:
                    kinds.append(stored_types([(fld.name, str(fld.type)) for fld in pq.read_schema(f)]))
            yield pd.DataFrame({"path": pdf["path"], "folder": [p.rpartition("/")[0] for p in pdf["path"]], "kind": kinds})
    return files.select("path").mapInPandas(run, "path string, folder string, kind string")


def _clean_folders(footers: DataFrame, whole: bool) -> list[str]:
    """The largest folders, from stations down to days, whose files are all canonical; of a listing of some
    days only (not ``whole``) the days' folders, as those above hold more than was listed."""
    if not whole:
        return sorted(r["folder"] for r in footers.groupBy("folder").agg(F.max("kind").alias("kind")).where("kind = ''").collect())
    parts = F.split("folder", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))
    mixed = footers.select(F.explode(levels).alias("at"), (F.col("kind") != "").alias("drift"), "folder").groupBy("at").agg(F.max("drift").alias("drift"))
    clean = mixed.where("NOT drift").select("at")
    above = clean.select(F.col("at").alias("parent"))
    top = clean.withColumn("parent", F.regexp_replace("at", "/[^/]*$", "")).join(above.where("parent <> ''"), "parent", "left_anti")
    own = clean.where(~F.col("at").contains("/")).select("at")  # a folder right under the root is its own parent
    return sorted(r["at"] for r in top.select("at").unionAll(own).distinct().collect())


def _native(spark: SparkSession, root: str, kind: str, paths: list[str]) -> DataFrame:
    """One scan of files of one kind: read as stored, cast to the canonical types."""
    stored = dict(x.split(" ", 1) for x in kind.split(", ")) if kind else {}
    # what has no values isn't read at all
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(stored.get(n, t.simpleString()))) for n, t in HEALTH_COLUMNS
                           if stored.get(n) != "void"] + PARTITION_SCHEMA.fields)
    rows = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    return rows.select(*[(F.col(n) if stored.get(n) != "void" else F.lit(None)).cast(t).alias(n) for n, t in HEALTH_COLUMNS], *PARTITION_SCHEMA.names)


def scan_health(spark: SparkSession, root: str, stations=None, dates=None) -> DataFrame:
    """Scan the health lake into the canonical 22 health columns plus partitions.

    The footers of the files under the requested folders are read first, in tasks; narrow the scan by
    ``stations`` and ``dates`` to read fewer. Without drift there is one native scan of the folders. With drift the
    names of the clean folders and of the drifted files pass through the driver, as Spark's own listing does.
    """
    root = root.rstrip("/")
    canonical_schema = T.StructType([T.StructField(n, t) for n, t in HEALTH_COLUMNS] + PARTITION_SCHEMA.fields)
    folders = [p for p in partition_paths(root, stations, dates) if any_match(spark, p)]  # days without data are no error
    if not folders:
        return spark.createDataFrame([], canonical_schema)
    footers = materialise(footer_kinds(list_files(spark, root, folders=folders), root), "health-footers")
    if footers.where("kind <> ''").isEmpty():
        return spark.read.schema(canonical_schema).option("basePath", root).parquet(*folders)
    mixed = footers.where("kind <> ''").select("folder").distinct()
    named: dict[str, list[str]] = {}
    for r in footers.where("kind <> ''").unionByName(footers.where("kind = ''").join(mixed, "folder", "left_semi").select(
            "path", "folder", "kind")).select("kind", "path").collect():
        named.setdefault(r["kind"], []).append(r["path"])
    groups = [(kind, sorted(paths)) for kind, paths in sorted(named.items())]
    if clean := _clean_folders(footers, whole=not dates):
        groups.insert(0, ("", clean))
    scans = [_native(spark, root, kind, [f"{root}/{p}" for p in paths]) for kind, paths in groups]
    return functools.reduce(DataFrame.unionByName, scans)

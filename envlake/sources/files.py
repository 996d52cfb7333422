"""File listing, content hashing and copying, distributed over Spark tasks.

Listing, hashing and copying run inside tasks through ``pyarrow.fs`` (local, HDFS, S3,
GCS). Listing opens no file and deals the folders it meets to tasks, round by round; hashing and
copying take one file at a time in 8 KiB..8 MiB chunks; nothing passes through the driver.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import os
import uuid
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envlake.session import materialise, ship_package, work_dir

_CHUNK = 8 * 1024 * 1024

# Hadoop's names of object stores and the names pyarrow has for them; other schemes that
# Hadoop alone knows are opened through its client library.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}
_NATIVE = ("s3", "gs", "abfs", "abfss", "hdfs", "viewfs")


def arrow_uri(uri: str) -> str:
    """A Hadoop URI by the scheme that pyarrow knows it by."""
    scheme, sep, rest = uri.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}://{rest}" if sep else uri


def _fs(uri: str):
    import pyarrow.fs as pafs
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    uri = arrow_uri(uri)
    scheme, _, rest = uri.partition("://")
    if scheme not in _NATIVE:
        raise ValueError(f"no file system for {scheme}:// in Python tasks")
    if scheme in ("hdfs", "viewfs"):
        host, _, path = rest.partition("/")
        return pafs.HadoopFileSystem(f"{scheme}://{host}" if host else "default"), "/" + path
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, uri: str) -> str:
    """A root with its scheme: one without is a path of Hadoop's default file system, as Spark reads it,
    not of whatever disk a task runs beside."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return p.getFileSystem(conf).makeQualified(p).toString().rstrip("/")


def _own_name(path: str) -> str:
    """A temporary name that no other attempt, task or host uses."""
    return f"{path}.{uuid.uuid4().hex}.tmp"


def _join(root: str, rel: str) -> str:
    return root.rstrip("/") + "/" + rel.lstrip("/")


def path_exists(spark: SparkSession, uri: str) -> bool:
    """Whether a folder or file exists, through the Hadoop file system of the URI."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def any_match(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or path pattern matches anything."""
    if "*" not in pattern:
        return path_exists(spark, pattern)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []))


#: Entries of a listing after which a task leaves the folders it meets to the next round.
_WALKED = 256
#: Entries of one frame of a listing.
_FRAME = 10_000


def _hidden(name: str) -> bool:
    """The names that Spark's readers pass over."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(fs, folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """``(name, whether a folder, size, time in ms)`` of what a folder holds; a local one is read as a stream."""
    import pyarrow.fs as pafs
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                with contextlib.suppress(FileNotFoundError):  # a link to nothing, or gone since
                    is_dir, stat = e.is_dir(), e.stat()
                    yield e.name, is_dir, stat.st_size, stat.st_mtime_ns // 1_000_000
        return
    for i in fs.get_file_info(pafs.FileSelector(folder)):
        yield i.base_name, i.type == pafs.FileType.Directory, i.size, None if i.mtime_ns is None else i.mtime_ns // 1_000_000


def _starts(spark: SparkSession, pattern: str) -> list[tuple[str, bool, int, int]]:
    """``(path, whether a folder, size, time in ms)`` of a path or of what a pattern matches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = (fs.globStatus(p) or []) if "*" in pattern else [fs.getFileStatus(p)]
    return [(s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in found]


def _walk(spark: SparkSession, root: str, starts: list[tuple[str, bool, int, int]]) -> DataFrame:
    """``(path, folder, size, ms)`` of everything below folders, listed in tasks. A task lists the folders it is given,
    and those in them up to some entries; the next round deals the others out anew. There are as many rounds as
    folders lie in each other, at most."""
    ship_package(spark)
    kind = "path string, folder boolean, size long, ms long"

    def run(batches):
        fs, base = _fs(root)
        rows = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame({"path": [r[0] for r in rows], "folder": [r[1] for r in rows],
                                "size": pd.array([r[2] for r in rows], dtype="Int64"), "ms": pd.array([r[3] for r in rows], dtype="Int64")})
            rows.clear()
            return out
        for pdf in batches:
            todo, seen = deque(pdf["path"]), 0
            while todo:
                folder = todo.popleft()
                for name, is_dir, size, ms in _entries(fs, _join(base, folder) if folder else base):
                    if _hidden(name):
                        continue
                    seen += 1
                    path = f"{folder}/{name}" if folder else name
                    if is_dir and seen <= _WALKED:
                        todo.append(path)
                    else:
                        rows.append((path, is_dir, size, ms))
                    if len(rows) >= _FRAME:
                        yield frame()
        if rows:
            yield frame()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = [spark.createDataFrame(starts, kind)]
    while not (folders := rounds[-1].where("folder").select("path")).isEmpty():
        rounds.append(materialise(folders.repartition(n, "path").mapInPandas(run, kind), "listing"))
    return functools.reduce(DataFrame.unionByName, rounds)


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet", folders: list[str] | None = None) -> DataFrame:
    """Recursive listing ``(path, size, last_modified)`` with root-relative paths, of all of
    ``root`` or of some folders (or patterns) below it. What is missing lists as empty; hidden
    folders (names that start with ``.`` or ``_``) and empty files aren't listed, as Spark's readers do. The listing is written as tables under the shared folder;
    only what ``folders`` match passes through the driver. A root that pyarrow has no file system for is listed by Spark's
    ``binaryFile`` source, whose driver holds every file's name."""
    root = root.rstrip("/")
    there = [f for f in folders or [root] if any_match(spark, f)]
    if not there:
        return spark.createDataFrame([], "path string, size long, last_modified timestamp")
    qroot = qualified(spark, root)
    scheme, sep, _ = arrow_uri(qroot).partition("://")
    if sep and scheme not in (*_NATIVE, "file"):
        return _list_by_reader(spark, qroot, glob, there)
    short = lambda path: path.replace("file:///", "file:/", 1)
    starts = [(short(p).removeprefix(short(qroot)).lstrip("/"), *rest) for f in there for p, *rest in _starts(spark, f)]
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    found = (_walk(spark, qroot, starts).where(~F.col("folder") & (F.col("size") > 0) & F.substring_index("path", "/", -1).rlike(f"^(?:{name})\\z"))
             .select("path", "size", F.timestamp_millis("ms").alias("last_modified")))
    return found.dropDuplicates(["path"]) if len(starts) > 1 else found  # folders may lie in each other


def _list_by_reader(spark: SparkSession, qroot: str, glob: str, there: list[str]) -> DataFrame:
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", glob).load(there)
          .select("path", "length", "modificationTime"))
    # Spark reports fully-qualified URIs; what follows the root is kept
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:///", "file:/"),
                           "^" + _regex_escape(qroot.replace("file:///", "file:/")) + "/", "")
    return df.select(rel.alias("path"), F.col("length").alias("size"),
                     F.col("modificationTime").alias("last_modified"))


def _regex_escape(s: str) -> str:
    import re
    return re.escape(s)


def list_remote(manifest: DataFrame, prefix: str = "") -> DataFrame:
    """Objects of a remote manifest under a key prefix."""
    return manifest.where(F.col("path").startswith(prefix)) if prefix else manifest


def _md5_file(fs, path: str) -> tuple[str, int]:
    h = hashlib.md5()
    n = 0
    with fs.open_input_stream(path) as f:
        while True:
            b = f.read(_CHUNK)
            if not b:
                break
            h.update(b)
            n += len(b)
    return '"' + h.hexdigest() + '"', n


def file_etags(paths: DataFrame, root: str) -> DataFrame:
    """``(path, e_tag)`` for root-relative paths, hashed inside executor tasks."""
    ship_package(paths.sparkSession)
    root = qualified(paths.sparkSession, root)

    def run(batches):
        fs, base = _fs(root)
        for pdf in batches:
            tags = [_md5_file(fs, _join(base, p))[0] for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "e_tag": tags})
    return paths.select("path").mapInPandas(run, "path string, e_tag string")


def by_bytes(files: DataFrame, tasks: int, size: str = "size") -> DataFrame:
    """The rows dealt to ``tasks`` partitions of about equal bytes (a file counts a little more than its bytes).

    Prefix sums over all sizes, cut into ranges: sums within each partition of the written listing, plus
    the sums of the partitions before (as many numbers as partitions)."""
    weight = F.coalesce(F.col(size), F.lit(0)) + F.lit(64 * 1024)
    rows = materialise(files.withColumn("_part", F.spark_partition_id()).withColumn("_weight", weight), "by-bytes")
    sums = {r["_part"]: r["w"] for r in rows.groupBy("_part").agg(F.sum("_weight").alias("w")).collect()}
    total, before, at = max(1, sum(sums.values())), [], 0
    for part in sorted(sums):
        before.append((part, at))
        at += sums[part]
    starts = files.sparkSession.createDataFrame(before, "_part int, _before long")  # one row for each partition
    inside = Window.partitionBy("_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_before") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))
    dealt = rows.join(F.broadcast(starts), "_part").withColumn("_range", F.floor(place * tasks / F.lit(total)).cast("int"))
    return dealt.repartitionById(tasks, "_range").drop("_part", "_weight", "_before", "_range")


def copy_files(todo: DataFrame, src_root: str, dst_root: str, attempts: int = 3) -> DataFrame:
    """Copy root-relative ``path`` rows from ``src_root`` to ``dst_root`` inside tasks.

    Returns ``(path, action, last_modified, bytes, e_tag, error)``; the MD5 is taken from the bytes copied.
    A file that can't be copied in so many attempts has the action ``failed`` and its error; the others are
    copied all the same, and the next replication finds what is missing. Copies are idempotent
    overwrites of whole objects, so a task that runs again is harmless."""
    ship_package(todo.sparkSession)
    src_root, dst_root = qualified(todo.sparkSession, src_root), qualified(todo.sparkSession, dst_root)

    def copy(sfs, src: str, dfs, dst: str) -> tuple[int, str]:
        dfs.create_dir(dst.rsplit("/", 1)[0], recursive=True)
        h, n, own = hashlib.md5(), 0, _own_name(dst)
        try:
            with sfs.open_input_stream(src) as fi, dfs.open_output_stream(own) as fo:
                while b := fi.read(_CHUNK):
                    h.update(b)
                    fo.write(b)
                    n += len(b)
            dfs.move(own, dst)
        except Exception:
            with contextlib.suppress(Exception):  # what is half written goes, if it can
                dfs.delete_file(own)
            raise
        return n, '"' + h.hexdigest() + '"'

    def run(batches):
        sfs, sbase = _fs(src_root)
        dfs, dbase = _fs(dst_root)
        for pdf in batches:
            rows = []
            for p, action in zip(pdf["path"], pdf["action"]):
                for left in range(attempts - 1, -1, -1):
                    try:
                        rows.append((action, *copy(sfs, _join(sbase, p), dfs, _join(dbase, p)), None))
                        break
                    except Exception as e:
                        if not left:
                            rows.append(("failed", 0, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=["action", "bytes", "e_tag", "error"], index=pdf.index)
            yield pdf.assign(action=out["action"], bytes=out["bytes"], e_tag=out["e_tag"], error=out["error"])
    return (todo.select("path", "action", "last_modified")
            .mapInPandas(run, "path string, action string, last_modified timestamp, bytes long, e_tag string, error string"))


def put_files(files: DataFrame, root: str) -> int:
    """Write each row's ``content`` as the file ``path`` under ``root``, inside tasks; how many."""
    ship_package(files.sparkSession)
    root = qualified(files.sparkSession, root)

    def run(batches):
        fs, base = _fs(root)
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                dst = _join(base, p)
                fs.create_dir(dst.rsplit("/", 1)[0], recursive=True)
                own = _own_name(dst)
                with fs.open_output_stream(own) as f:
                    f.write(content)
                fs.move(own, dst)
            yield pd.DataFrame({"n": [len(pdf)]})
    return files.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


#: Bytes of disk that the files of a part take at once, where this gives no more parts than the last value; a file counts
#: its bytes and so many for its folders and blocks.
_PART, _FILE, _PARTS = 256 * 1024 * 1024, 16 * 1024, 8


def in_parts(files: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``files`` ``(path, content)`` in parts, for those who write them as files, use these and drop them again.

    All rows of a path are in one part, by its hash. The rows are written once as a table under the shared folder, with a
    folder for each part, which goes when the next part is asked for. Few files are one part, and aren't written."""
    spark = files.sparkSession
    total = files.agg(F.sum(F.coalesce(F.length("content"), F.lit(0)) + F.lit(_FILE))).first()[0] or 0
    n = min(_PARTS, -(-total // _PART))
    if n <= 1:
        yield files
        return
    table = work_dir(spark, "parts")
    try:
        files.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(n))).write.partitionBy("part").parquet(table)
        for k in range(n):
            if path_exists(spark, part := f"{table}/part={k}"):
                yield spark.read.schema(files.schema).parquet(part)
                _drop(spark, part)
    finally:
        _drop(spark, table)


def _drop(spark: SparkSession, root: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_files(files: DataFrame, root: str) -> None:
    """Remove ``root``, a folder of its caller's own that :func:`put_files` filled: inside tasks each row's file ``path`` and
    the local folders that are empty then, last what is left."""
    if reason := refuse_root(root):
        raise ValueError(reason)
    spark = files.sparkSession
    ship_package(spark)
    qroot = qualified(spark, root)

    def run(batches):
        import pyarrow.fs as pafs
        fs, base = _fs(qroot)
        for pdf in batches:
            for p in pdf["path"]:
                with contextlib.suppress(FileNotFoundError):  # a path may come twice
                    fs.delete_file(_join(base, p))
                with contextlib.suppress(OSError):  # a folder that others still use, or have removed
                    while isinstance(fs, pafs.LocalFileSystem) and (p := p.rpartition("/")[0]):
                        os.rmdir(_join(base, p))
            yield pd.DataFrame({"n": [len(pdf)]})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.select("path").repartition(n, "path").mapInPandas(run, "n long").agg(F.sum("n")).first()
    _drop(spark, root)


# Folders that replication is refused from, by name and by place (with the home folder).
_DANGEROUS_NAMES = (".cache", ".local", ".config", "cache", "tmp", "temp")
_DANGEROUS_ROOTS = ("/", "/home", "/tmp", "/var")


def refuse_root(local_root: str) -> str | None:
    """Reason to refuse replicating ``local_root`` (system, home or cache folder), or None."""
    if "://" in local_root and not local_root.startswith("file:"):
        p = local_root.rstrip("/")
        name = p.rsplit("/", 1)[-1].lower()
        return "cache/temp folder" if name in _DANGEROUS_NAMES else None
    path = Path(local_root[5:] if local_root.startswith("file:") else local_root).resolve()
    for d in (Path.home(), *map(Path, _DANGEROUS_ROOTS)):
        if path == d.resolve():
            return f"refusing to sync from {path}"
    if path.name.lower() in _DANGEROUS_NAMES:
        return f"{path} looks like a cache/temp folder"
    return None

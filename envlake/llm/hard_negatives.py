"""Hard negatives: exact search in Hilbert-ordered blocks with zone maps.

All vectors are sorted along a Hilbert curve through their first principal directions and cut into
blocks of ``BLOCK`` rows, which are written as Parquet; ``SHELF`` rows (whole blocks) are worked on
together. Each block has a zone map: the least and the largest value of every dimension, and its
labels' range. For an anchor ``a`` the products with a block's rows lie between
``sum(min(a_i * lo_i, a_i * hi_i))`` and ``sum(max(a_i * lo_i, a_i * hi_i))``, in integers.

An anchor first reads its own shelf, which bounds its ``k``-th best positive from below; then every
block that may hold a better one. The positives' scores are windows for the negatives: again the own
shelf bounds each window's ``k``-th best, and every block is read whose interval meets what is left of
a window. Nothing else is skipped, so the result is that of a scan over all rows. How many blocks
are skipped depends on the data alone: vectors that fill a sphere evenly leave little to skip.

Work per shelf is a sorted stream: the shelf's vectors (bounded), then its anchors, a batch at a
time. No broadcast; sums over ``dim * dim`` cells are all that reaches the driver.

Defined results: rows with a null id, label or vector, with another number of components than
``dim`` or with a null or non-finite one take no part; a scaled component beyond 2**27 is an error.
Rows are told apart by place, so a repeated row is another row, and each anchor row has results of its
own. A window of a negative positive score is empty. An empty table gives none. Only the columns
named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlake.llm.common import save, ship_package
from envlake.llm.embedding import finite, ints, matrix, products, scaled

BLOCK, SHELF = 512, 8192
#: Anchors whose bounds are held against the zone maps together, and those scored at a time.
CHUNK, AT_A_TIME = 1024, 128
#: Principal directions of the curve, and bits of each.
AXES, BITS = 8, 7
_LEAST = -(1 << 62)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates in ``[0, 2**bits)``."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit down
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray encode
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    place = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _directions(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, principal directions and their spreads, from sums over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            v = matrix(b.column("v"), dim).astype(float)
            n, s, ss = n + len(v), s + v.sum(axis=0), ss + v.T @ v
        flat = np.concatenate([[n], s, ss.reshape(-1)])
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, pa.float64())], ["i", "x"])
    flat = np.zeros(1 + dim + dim * dim)
    for r in rows.select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[r["i"]] = r["x"]
    n = max(flat[0], 1.0)
    mean = flat[1:1 + dim] / n
    values, vectors = np.linalg.eigh(flat[1 + dim:].reshape(dim, dim) / n - np.outer(mean, mean))
    first = np.argsort(values)[::-1][:AXES]
    return mean, vectors[:, first], np.sqrt(np.maximum(values[first], 1e-9))


def ordered_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """``(row, block, shelf, vec_id, label, anchor, v)`` in Hilbert order, written as Parquet. ``row``
    numbers the rows, whatever the partitions, so that every block but the last is full; copies of one vector are
    spread by their ids."""
    mean, axes, spread = _directions(rows, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (matrix(b.column("v"), dim) - mean) @ axes / spread  # about -4 to 4
            cells = np.clip(np.floor((at + 4) * (1 << BITS) / 8), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cells, BITS), pa.int64())], [*b.schema.names, "h"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(np.arange(at, at + b.num_rows), pa.int64()),
                                              *b.columns], ["part", "place", *b.schema.names])
            at += b.num_rows
    kinds = "vec_id long, label long, anchor boolean, v array<int>"
    along = rows.mapInArrow(place, f"{kinds}, h long").withColumn("salt", F.xxhash64("vec_id"))
    dealt = along.repartitionByRange("h", "salt").sortWithinPartitions("h", "salt", "vec_id", "label", "v")
    parts = save(dealt.select("vec_id", "label", "anchor", "v").mapInArrow(number, f"part int, place long, {kinds}"), "hard-negative-order")
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one number for each partition
    before = list(zip(sorted(sizes), np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist()))
    row = F.col("place") + F.col("before")
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    return save(parts.join(starts, "part").select(row.alias("row"), F.floor(row / BLOCK).alias("block"), F.floor(row / SHELF).alias("shelf"),
                                                  "vec_id", "label", "anchor", "v"), "hard-negative-blocks")


def zone_maps(blocks: DataFrame, dim: int) -> DataFrame:
    """``(shelf, block, least_label, most_label, lo, hi)`` of each block."""
    own = [f(F.col("v")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(dim)]
    found = blocks.groupBy("shelf", "block").agg(F.min("label").alias("least_label"), F.max("label").alias("most_label"), *own)
    return save(found.select("shelf", "block", "least_label", "most_label",
                             *[F.array(*[f"{n}{i}" for i in range(dim)]).alias(n) for n in ("lo", "hi")]), "hard-negative-zones")


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal values of the columns named."""
    keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            yield tuple(keys[i].tolist()), batch.slice(i, j - i)


def _lists(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_SEEKER = "row long, vec_id long, label long, v array<int>, lo array<long>, hi array<long>"


def blocks_to_read(seekers: DataFrame, zones: DataFrame, same: bool, dim: int) -> DataFrame:
    """``(shelf, blocks, ...)`` for each seeker and each shelf but its own with a block that may hold a row of the
    same label, or of another, with a product in one of the seeker's windows ``[lo[j], hi[j]]``."""
    chunks = max(1, -(-seekers.count() // CHUNK))
    one = seekers.select(F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("chunk"), F.lit(0).alias("kind"), "row", "vec_id", "label", "v", "lo", "hi")
    every = zones.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c")).select(
        F.col("c").cast("long").alias("chunk"), F.lit(1).alias("kind"), F.col("block").alias("row"), F.col("least_label").alias("vec_id"),
        F.col("most_label").alias("label"), F.col("lo").alias("v"), F.lit(None).cast("array<bigint>").alias("lo"), F.col("hi").cast("array<bigint>").alias("hi"))

    def told(shelf: int, who: pa.RecordBatch, need: np.ndarray, block: np.ndarray) -> pa.RecordBatch | None:
        some = np.flatnonzero(need.any(axis=1) & (who.column("row").to_numpy() // SHELF != shelf))
        if not len(some):
            return None
        chosen = pa.array([block[need[i]].tolist() for i in some], pa.list_(pa.int64()))
        own = who.take(pa.array(some))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shelf), pa.int64()), chosen, *own.columns], ["shelf", "blocks", *own.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = who = shelf = None
        held: list = []
        for batch in batches:
            for (c, kind), part in _runs(batch, "chunk", "kind"):
                if c != chunk:
                    if held:
                        yield from filter(None, [told(shelf, who, np.column_stack([h[0] for h in held]), np.concatenate([h[1] for h in held]))])
                    chunk, who, shelf, held = c, None, None, []
                if kind == 0:
                    part = part.select(["row", "vec_id", "label", "v", "lo", "hi"])
                    who = part if who is None else pa.concat_batches([who, part])
                    continue
                if who is None:
                    continue
                a, label = matrix(who.column("v"), dim), who.column("label").to_numpy()
                lo, hi = _lists(who.column("lo")), _lists(who.column("hi"))
                for (s,), zone in _runs(part.append_column("s", pa.array(part.column("row").to_numpy() * BLOCK // SHELF, pa.int64())), "s"):
                    if s != shelf and held:
                        yield from filter(None, [told(shelf, who, np.column_stack([h[0] for h in held]), np.concatenate([h[1] for h in held]))])
                        held = []
                    shelf = s
                    least, most = (_lists(zone.column(c)).astype(np.int64) for c in ("v", "hi"))
                    up, down = np.maximum(a, 0), np.minimum(a, 0)
                    top = products(up, most) + products(down, least)
                    low = products(up, least) + products(down, most)
                    first, last = zone.column("vec_id").to_numpy(), zone.column("label").to_numpy()
                    fits = (first <= label[:, None]) & (label[:, None] <= last)
                    fits = fits if same else ~((first == last) & fits)
                    meets = np.zeros(top.shape, dtype=bool)
                    for j in range(lo.shape[1]):
                        meets |= (top >= lo[:, j:j + 1]) & (low <= hi[:, j:j + 1]) & (lo[:, j:j + 1] <= hi[:, j:j + 1])
                    held.append((fits & meets, zone.column("row").to_numpy()))
        if held:
            yield from filter(None, [told(shelf, who, np.column_stack([h[0] for h in held]), np.concatenate([h[1] for h in held]))])
    return save(one.unionByName(every).repartition("chunk").sortWithinPartitions("chunk", "kind", "row")
                .mapInArrow(run, f"shelf long, blocks array<long>, {_SEEKER}"), "hard-negative-visits")


def best_in_blocks(blocks: DataFrame, visits: DataFrame, same: bool, k: int, dim: int) -> DataFrame:
    """``(row, j, vec_id, score)``: for each visit and window ``j``, the ``k`` first rows in its blocks, of the
    same label without the row itself or of another, by score and then id."""
    wanted = visits.select(F.explode("blocks").alias("block")).distinct()
    none = F.lit(None)
    stock = blocks.join(wanted, "block", "left_semi").select(
        "shelf", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", *[none.cast("array<bigint>").alias(c) for c in ("lo", "hi", "blocks")])
    asked = visits.select("shelf", F.lit(1).alias("kind"), "row", "vec_id", "label", "v", "lo", "hi", "blocks")

    def seek(v, label, ids, row, who) -> Iterator[tuple]:
        place = row // BLOCK
        s = products(matrix(who.column("v"), dim), v)
        lo, hi, own = _lists(who.column("lo")), _lists(who.column("hi")), who.column("row").to_numpy()
        wants, to_read = who.column("label").to_numpy(), who.column("blocks").to_pylist()
        for i in range(len(s)):
            fits = (label == wants[i]) & (row != own[i]) if same else label != wants[i]
            at = np.flatnonzero(fits & (s[i] >= lo[i].min()) & (s[i] <= hi[i].max()) & np.isin(place, to_read[i]))
            score = s[i][at]
            for j in range(lo.shape[1]):
                inside = np.flatnonzero((score >= lo[i, j]) & (score <= hi[i, j]))
                if len(inside) > k:  # all that tie with the k-th stay until they are sorted
                    inside = inside[score[inside] >= np.partition(score[inside], len(inside) - k)[len(inside) - k]]
                for t in inside[np.lexsort((ids[at[inside]], -score[inside]))[:k]]:
                    yield int(own[i]), j, int(ids[at[t]]), int(score[t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, parts, held = None, [], None
        for batch in batches:
            for (s, kind), part in _runs(batch, "shelf", "kind"):
                if s != shelf:
                    shelf, parts, held = s, [], None
                if kind == 0:
                    parts.append(part.select(["row", "vec_id", "label", "v"]))
                    continue
                if held is None and parts:
                    one = pa.concat_batches(parts)
                    held = matrix(one.column("v"), dim), *(one.column(c).to_numpy() for c in ("label", "vec_id", "row"))
                if held is None:
                    continue
                for i in range(0, part.num_rows, AT_A_TIME):
                    found = list(seek(*held, part.slice(i, AT_A_TIME)))
                    if found:
                        row, j, vec_id, score = zip(*found)
                        yield pa.record_batch([pa.array(row, pa.int64()), pa.array(j, pa.int32()), pa.array(vec_id, pa.int64()),
                                               pa.array(score, pa.int64())], ["row", "j", "vec_id", "score"])
    return save(stock.unionByName(asked).repartition("shelf").sortWithinPartitions("shelf", "kind", "row")
                .mapInArrow(run, "row long, j int, vec_id long, score long"), "hard-negative-found")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each seeker and window, with their rank; cut to ``k`` before the shuffle, too."""
    by = Window.partitionBy("row", "j").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _search(blocks: DataFrame, zones: DataFrame, seekers: DataFrame, same: bool, k: int, dim: int) -> DataFrame:
    """The first ``k`` rows of every window: those of the own shelf, which narrow the windows, then of all blocks left."""
    every = blocks.select("shelf", "block").distinct().groupBy("shelf").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    home = seekers.withColumn("shelf", F.floor(F.col("row") / SHELF)).join(every, "shelf")
    near = best_in_blocks(blocks, home, same, k, dim)
    bound = (_first(near, k).where(F.col("rank") == k).groupBy("row")
             .agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("least")))
    narrowed = seekers.join(bound, "row", "left").withColumn("lo", F.transform(
        "lo", lambda x, j: F.greatest(x, F.coalesce(F.col("least")[j], x)))).drop("least")
    narrowed = save(narrowed, "hard-negative-seekers")
    far = best_in_blocks(blocks, blocks_to_read(narrowed, zones, same, dim), same, k, dim)
    return _first(near.unionAll(far), k)


def mine_hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                        scale: int = 256, dim: int = 64, vec: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows whose column
    ``anchor`` is true. Of ``rows`` it takes ``vec_id``, ``label``, ``anchor`` and the vector."""
    ship_package(rows.sparkSession)
    v = F.col(vec).cast("array<double>")
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(v, dim)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"), scaled(v, scale).alias("v"))
    blocks = ordered_blocks(save(kept, "hard-negative-rows"), dim)
    zones = zone_maps(blocks, dim)
    anchors = blocks.where("anchor").select("row", "vec_id", "label", "v")

    def wide(lo, hi, of: DataFrame) -> DataFrame:
        return of.select("row", "vec_id", "label", "v", lo.alias("lo"), hi.alias("hi"))
    all_scores = wide(F.array(F.lit(_LEAST)), F.array(F.lit(-_LEAST)), anchors)
    found = save(_search(blocks, zones, all_scores, True, positives, dim)
                 .select("row", (F.col("rank") - 1).alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                 "hard-negative-positives")
    scores = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("j", "positive_score"))).alias("p"))
    # windows in order of the positives; those that an anchor with fewer positives lacks are empty
    spot = [F.get("p", F.lit(j))["positive_score"] for j in range(positives)]
    lo = F.array(*[F.coalesce(-F.floor(-(p * low) / 100), F.lit(1)).cast("long") for p in spot])
    hi = F.array(*[F.coalesce(F.floor(p * high / 100), F.lit(0)).cast("long") for p in spot])
    seekers = save(wide(lo, hi, anchors.join(scores, "row")), "hard-negative-windows")
    mined = _search(blocks, zones, seekers, False, negatives, dim)
    return (mined.join(found, ["row", "j"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def embeddings_with_anchors(rows: DataFrame) -> DataFrame:
    """Every hundredth id is an anchor; every seventh id has the next label."""
    i, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return rows.select(i.alias("vec_id"), F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                       (i % 100 == 0).alias("anchor"), "embedding")


ORACLE_SQL = """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
    SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same,
           list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::BIGINT AS score
    FROM kept a JOIN kept b ON a.r <> b.r AND a.vec_id % 100 = 0),
positive AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS j FROM scored WHERE same QUALIFY j <= 5),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.r, p.j ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positive p JOIN scored n ON p.r = n.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

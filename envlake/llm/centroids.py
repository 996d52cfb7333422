"""Exact k-means by shallot search.

Each vector carries the number of its nearest centroid, the number of its second-nearest one, an upper
bound of the distance to the first and a lower bound of the distance to all others. When the centroids
move, the bounds move with them; a vector whose bounds still part is settled without a distance. The rest
measure their two remembered centroids, start from the closer one and walk its neighbours in order of
distance: a centroid can matter only inside the ball of radius (distance to the start + distance to
the second-nearest found so far), which shrinks as better ones are found. Those inside the ball are
compared by their squared distances in integers, so that ties go to the smaller number.

Bounds are square roots in doubles, widened by ``_SLACK`` to the safe side; they only skip work.
Each round writes the vectors with their state; sums of each cluster (``k`` rows) reach the driver,
which holds ``k`` centroids. ``k`` is a parameter, so what is sent to the tasks doesn't grow with the data.

Defined results: vectors with another number of components than ``dim``, or with a null or non-finite
one, are left out; a scaled component beyond 2**27 is an error. A null id is clustered but never a
first centroid; a repeated row is clustered each time, and may be two first centroids (rows with equal
ids are taken in the order of their components). With fewer vectors than ``k`` there are fewer
centroids; an empty table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import save, ship_package
from envlake.llm.embedding import finite, matrix, scaled

_SLACK = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, second int, upper double, lower double, distance long"


@dataclass(frozen=True)
class Centres:
    """Centroids in integers, how far each has moved, and every centroid's neighbours by distance."""

    at: np.ndarray
    moved: np.ndarray
    apart: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centres:
        apart = np.sqrt(((at[:, None] - at[None]).astype(float) ** 2).sum(axis=2))
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before).astype(float) ** 2).sum(axis=1))
        order = np.argsort(apart + np.where(np.eye(len(at), dtype=bool), -1.0, 0.0), axis=1, kind="stable")
        return cls(at, moved * (1 + _SLACK), apart, order[:, 1:])


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((v - c) ** 2).sum(axis=1)


def shallot(v: np.ndarray, c: Centres, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
            fresh: bool, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New ``first``, ``second``, ``upper``, ``lower`` and the squared distance to ``first`` (-1 where it
    wasn't measured; with ``exact`` it always is). ``fresh``: there are no bounds yet."""
    n, k = len(v), len(c.at)
    first, second, upper, lower = first.copy(), second.copy(), upper.copy(), lower.copy()
    distance = np.full(n, -1, dtype=np.int64)
    if k == 1:
        first[:] = second[:] = 0
        return first, second, upper, lower, _squared(v, c.at[first]) if n else distance
    if fresh:
        first[:], second[:] = 0, c.near[0, 0]
        todo = np.arange(n)
    else:
        most = np.argsort(c.moved)[::-1][:2]
        upper += c.moved[first]
        lower = lower - np.where(first == most[0], c.moved[most[1]], c.moved[most[0]])
        clear = np.maximum(lower, c.apart[first, c.near[first, 0]] * (1 - _SLACK) / 2)
        todo = np.arange(n) if exact else np.flatnonzero(upper >= clear)
        distance[todo] = _squared(v[todo], c.at[first[todo]])
        upper[todo] = np.sqrt(distance[todo]) * (1 + _SLACK)
        lower = np.where(upper < clear, clear, lower)
        todo = todo[upper[todo] >= clear[todo]]
    if not len(todo):
        return first, second, upper, lower, distance
    x = v[todo]
    one, two = first[todo], second[todo]
    d1, d2 = _squared(x, c.at[one]), _squared(x, c.at[two])
    swap = (d2 < d1) | ((d2 == d1) & (two < one))
    one, two = np.where(swap, two, one), np.where(swap, one, two)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, known = one.copy(), two.copy()
    out = np.sqrt(d1) * (1 + _SLACK)
    live = np.arange(len(todo))
    for r in range(k - 1):
        it = c.near[start[live], r]
        live = live[c.apart[start[live], it] * (1 - _SLACK) <= out[live] + np.sqrt(d2[live]) * (1 + _SLACK)]
        if not len(live):
            break
        it = c.near[start[live], r]
        new = it != known[live]
        at, it = live[new], it[new]
        d = _squared(x[at], c.at[it])
        nearer = (d < d1[at]) | ((d == d1[at]) & (it < one[at]))
        next_ = ~nearer & ((d < d2[at]) | ((d == d2[at]) & (it < two[at])))
        a, b = at[nearer], at[next_]
        two[a], d2[a] = one[a], d1[a]
        one[a], d1[a] = it[nearer], d[nearer]
        two[b], d2[b] = it[next_], d[next_]
    first[todo], second[todo], distance[todo] = one, two, d1
    upper[todo] = np.sqrt(d1) * (1 + _SLACK)
    lower[todo] = np.sqrt(d2) * (1 - _SLACK)
    return first, second, upper, lower, distance


def _assign(rows: DataFrame, c: Centres, dim: int, fresh: bool, exact: bool, name: str) -> DataFrame:
    """One round over all vectors, written with their state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if fresh:
                old = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
            else:
                old = (b.column("cluster").to_numpy().astype(np.int64), b.column("second").to_numpy().astype(np.int64),
                       b.column("upper").to_numpy(), b.column("lower").to_numpy())
            new = shallot(matrix(b.column("v"), dim), c, *old, fresh, exact)
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), *(pa.array(x, t) for x, t in zip(new, kinds))],
                                             ["vec_id", "v", "cluster", "second", "upper", "lower", "distance"])
    return save(rows.mapInArrow(run, _STATE), name)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.where("vec_id IS NOT NULL").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in found], dtype=np.int64)


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, dim: int = 64,
            vec: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, v, cluster, second, upper, lower, distance)`` of every vector after ``rounds`` rounds and a last
    assignment, and the final centroids."""
    ship_package(rows.sparkSession)
    v = F.col(vec).cast("array<double>")
    kept = save(rows.where(finite(v, dim)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(v, scale).alias("v")), "centroid-vectors")
    at = first_centroids(kept, k, seed)
    if not len(at):
        empty = kept.where("false").select("vec_id", "v", *[F.lit(None).cast(t).alias(c) for c, t in
                                           (("cluster", "int"), ("second", "int"), ("upper", "double"), ("lower", "double"), ("distance", "long"))])
        return empty, at
    state, c = kept, Centres.of(at)
    for r in range(rounds):
        state = _assign(state, c, dim, r == 0, False, f"centroid-round{r}")
        new = c.at.copy()
        sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)]
        for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # at most k rows
            new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
        c = Centres.of(new, c.at)
    return _assign(state, c, dim, rounds == 0, True, "centroid-last"), c.at


def clustered(rows: DataFrame) -> DataFrame:
    """Every vector's cluster and distance, with the sums of its cluster and of all, and its centroid's digest."""
    state, at = cluster(rows)
    spark = rows.sparkSession
    parts = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    told = [(j, parts.get(j, 0), sum(parts.values()), sha256(",".join(map(str, x)).encode()).hexdigest()) for j, x in enumerate(at.tolist())]
    centres = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(centres), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """SQL for the assignment to the centroids ``c{n}`` and the centroids after it."""
    return f"""
a{n} AS MATERIALIZED (
    SELECT r, vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM (
        SELECT k.*, c, list_sum(list_transform(list_zip(k.v, z.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
        FROM kept k CROSS JOIN c{n} z) GROUP BY r, vec_id, v),
m{n} AS (
    SELECT c, list(m ORDER BY i) AS v FROM (
        SELECT best.c AS c, i, floor(sum(x)::DECIMAL(38, 0) / count(*))::BIGINT AS m
        FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY ALL) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, z.v) AS v FROM c{n} z LEFT JOIN m{n} m USING (c))"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
    QUALIFY c < 16),{",".join(_round(n) for n in range(4))}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = best.c
"""

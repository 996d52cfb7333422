"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch holds the ``k`` smallest distinct 48-bit hashes of a text's five-word shingles (A-Z
folded). Sketches of parts merge to the sketch of their union, and two of them estimate
resemblance, containment and the number of distinct shingles. As text a fingerprint is the
base64 form of its hashes in ascending order, six bytes each.

Defined results: a null or blank text has the empty fingerprint; two empty ones resemble each
other fully, an empty and another one not at all. Texts with fewer than five words have one
shingle. Equal texts have equal fingerprints. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import id_text, ship_package, slices
from envlake.llm.vec import shingles_of

WORDS = 5
K = 256
_BITS = 48


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The bottom-k sketch of each text: ascending distinct 48-bit hashes."""
    h, at = shingles_of(texts, words)
    h = h >> np.uint64(64 - _BITS)
    return [_lowest(h[a:b], k) for a, b in zip(at[:-1], at[1:])]


def _lowest(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) > 8 * k:  # the threshold is the 4k-th smallest; repeated hashes may need all of them
        part = np.unique(np.partition(h, 4 * k)[:4 * k])
        if len(part) >= k:
            return part[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles (exact below ``k``)."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** _BITS / (float(a[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that both sketches hold."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.concatenate([a, b])
    both.sort()
    new = np.empty(len(both), dtype=bool)
    new[0] = True
    np.not_equal(both[1:], both[:-1], out=new[1:])
    at = np.flatnonzero(new)[:k]
    twice = np.append(~new[1:], False)[at]
    return float(np.count_nonzero(twice)) / len(at)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(s: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s or ""), dtype=np.uint8).reshape(-1, _BITS // 8)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """``(doc_id, fingerprint, n_distinct)`` of every row; no shuffle."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = sketches([t.encode() for t in b.column("text").to_pylist()], k, words)
            yield pa.record_batch([b.column("doc_id"), pa.array(map(encode, found), pa.string()),
                                   pa.array([distinct(s, k) for s in found], pa.float64())], _FINGERPRINT)
    return id_text(docs).mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


_FINGERPRINT = ["doc_id", "fingerprint", "n_distinct"]


def merge_fingerprints(sketched: DataFrame, group: str, k: int = K, salt: int = 32) -> DataFrame:
    """``(group, fingerprint, n_distinct)``: the sketch of each group's union.

    Rows are merged twice as a stream over sorted partitions, first for each group and salt, then
    for each group, so a task holds one sketch at a time however large a group is. Null
    fingerprints count as empty; null is a group of its own.
    """
    ship_package(sketched.sparkSession)
    kind = sketched.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, any_row = None, None, False
        done: list = []
        for b in batches:
            for key, s in zip(b.column("g").to_pylist(), b.column("fingerprint").to_pylist()):
                if any_row and key == now:
                    held = merge(held, decode(s), k)
                    continue
                if any_row:
                    done.append((now, encode(held), distinct(held, k)))
                now, held, any_row = key, decode(s)[:k], True
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("g", "fingerprint", "n_distinct"), r)) for r in done],
                                                 schema=pa.schema([("g", b.schema.field("g").type),
                                                                   ("fingerprint", pa.string()),
                                                                   ("n_distinct", pa.float64())]))
                done = []
        if any_row:
            yield pa.RecordBatch.from_pylist([{"g": now, "fingerprint": encode(held), "n_distinct": distinct(held, k)}],
                                             schema=pa.schema([("g", b.schema.field("g").type),
                                                               ("fingerprint", pa.string()),
                                                               ("n_distinct", pa.float64())]))
    out = f"g {kind}, fingerprint string, n_distinct double"
    rows = sketched.select(F.col(group).alias("g"), "fingerprint")
    salted = rows.withColumn("s", F.pmod(F.xxhash64("fingerprint"), F.lit(salt)))
    first = (salted.repartition("g", "s").sortWithinPartitions("g").select("g", "fingerprint").mapInArrow(run, out))
    both = first.select("g", "fingerprint").repartition("g").sortWithinPartitions("g").mapInArrow(run, out)
    return both.withColumnRenamed("g", group)


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, n_distinct double, edited_in_text double")


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, tasks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text replaces the last ``n_chars // 4`` code points by the first as many (or all)
    of the next document in ascending ``doc_id`` order (rows that share an id by text, rows
    without id first; the last row is followed by the first). Rows are dealt out by ranges of
    ``doc_id`` of about equal counts; each range also gets the first row of the next one, and is
    read as a sorted stream, so a task holds a slice of rows and no text is moved twice.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = id_text(docs)
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10000, 20 * n)),
                    F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    least = cuts[1] if not cuts[2] else None
    edges = np.unique(np.array([c for c in (cuts[0] or []) if c != cuts[1]], dtype=np.int64)) if n > 1 else np.zeros(0, np.int64)
    last = len(edges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the range of each row; a range's first id goes to the range before as well."""
        names = ["part", "tail", "doc_id", "text"]
        for b in slices(batches):
            ids = b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(null, 0, np.searchsorted(edges, value, side="right"))
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(np.zeros(len(part)), pa.int32()),
                                   ids, b.column("text")], names)
            first = null if least is None else ~null & (value == least)
            opens = ~null & np.isin(value, edges)
            for which, to in ((first, np.full(len(part), last)), (opens, part - 1)):
                at = np.flatnonzero(which)
                if len(at):
                    yield pa.record_batch([pa.array(to[at], pa.int32()), pa.array(np.ones(len(at)), pa.int32()),
                                           ids.take(pa.array(at)), b.column("text").take(pa.array(at))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in slices(batches):
            seen = list(zip(b.column("part").to_pylist(), b.column("tail").to_pylist(),
                            b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
            raw = [r[3].encode() for r in seen]
            known = [(*r, s) for r, s in zip(seen, sketches(raw, k, words))]
            if held is not None:
                known = [held, *known]
            pairs = [(x, y) for x, y in zip(known, known[1:]) if x[0] == y[0] and not x[1]]
            held = known[-1]
            edited = []
            for x, y in pairs:
                cut = len(x[3]) // 4
                edited.append((x[3][:len(x[3]) - cut] + y[3][:cut]).encode())
            if not pairs:
                continue
            own = sketches(edited, k, words)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([x[2] for x, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": [encode(x[4]) for x, _ in pairs],
                "edited_fingerprint": [encode(e) for e in own],
                "near_edited": [resemblance(x[4], e, k) for (x, _), e in zip(pairs, own)],
                "near_next": [resemblance(x[4], y[4], k) for x, y in pairs],
                "n_distinct": [distinct(x[4], k) for x, _ in pairs],
                "edited_in_text": [containment(e, x[4], k) for (x, _), e in zip(pairs, own)]})
    dealt = rows.mapInArrow(deal, "part int, tail int, doc_id long, text string")
    return (dealt.repartitionById(last + 1, "part").sortWithinPartitions("part", "tail", "doc_id", "text")
            .mapInArrow(run, _EDITED))

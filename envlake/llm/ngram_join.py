"""Exact Jaccard join of word n-gram sets by partitions of the universe.

Two sets link when ``100 * |A & B| >= 85 * |A | B|``; then they differ in at most ``H`` elements,
a bound that follows from their sizes. Sets fall into size bands; in each band a hash cuts the
universe into segments. If the segments outnumber ``H``, two linked sets agree on a whole
segment, and a segment indexed with its one-deletion neighbourhood counts as two. For each band
the numbers of segments and of neighbourhoods are those of least estimated cost (rows written
against rows that meet by chance). Beside the ``H + 1`` needed, a band has ``2 * e`` spare ones:
every set leaves out up to ``e`` of its own, blank and crowded ones first, and some common
segment is still indexed by both.

Equal sets have one digest and go on as one. What meets in a small segment is held against each
other by exact bounds (sizes, and parity maps whose differing bits can't outnumber differing
elements). In a large one, members first drop out by another exact bound (elements that no other
member has can't be shared), then each is held against the member with the fewest such elements,
then, where a segment still holds several components, against all members the bounds allow. Each
pair left is verified on whole sets, so no link between components is lost.
:func:`jaccard_components` needn't list pairs inside a component; :func:`jaccard_links` holds all
members of a large segment against each other and lists every link. Its rows grow with the links,
in a crowd of near copies with different texts as the square of its size.

Defined results: a text without words, or null, has an empty set, links with nothing and is its
own component. A row without ``doc_id`` links like any other but names no component (null, where
no linked row has an id); rows that share a ``doc_id`` are judged each by its own text. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlake.llm.common import id_text, save, ship_package, slices
from envlake.llm.graph import components
from envlake.llm.vec import mix64, shingles_of

PART, WHOLE = 85, 100
#: Size bands grow by this factor, or by as much as sizes of linked sets can differ.
WIDTH = 1.26
#: Segments a set may leave out, as a share of those needed. Where documents share passages, about
#: so many of a set's segments lie inside one and are crowded.
SPARE = 0.16
#: Rows that meet by chance in a blank segment are as dear as so many rows written.
CROWD = 300.0
_SEG, _SUM, _KEY1, _KEY2, _SALT = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93,
                                                          0xCA9B0F1D5E1A6B27, 0x2545F4914F6CDD1D))


def most_apart(a: int, b: int, part: int = PART, whole: int = WHOLE) -> int:
    """The most elements in which linked sets of these sizes can differ (-1: they can't link)."""
    common = -(-part * (a + b) // (part + whole))
    return a + b - 2 * common if common <= min(a, b) else -1


@functools.lru_cache(None)
def bands(largest: int, part: int = PART, whole: int = WHOLE) -> tuple[tuple[int, int, int, int, int], ...]:
    """``(least size, H, segments, neighbourhoods, e)`` of each band up to a size."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * WIDTH) - 1, (low - 1) * whole // part)  # partners are one band up at most
        if high <= 400:
            h = max(most_apart(a, b, part, whole) for b in range(low, high + 1) for a in range(max(1, part * low // whole), b + 1))
        else:
            h = 2 * high * (whole - part) // (whole + part)
        if h > 0:
            out.append((low, h, *_allocation(low, high, h)))
        else:
            out.append((low, h, 0, 0, 0))  # only equal sets link
        low = high + 1
    return tuple(out)


def _allocation(low: int, high: int, h: int) -> tuple[int, int, int]:
    """Segments, how many of them with one-deletion neighbourhoods, and spare ones per side."""
    best = None
    spare = math.ceil(SPARE * (h + 1)) + 1
    for e, m in [(0, m) for m in range(1, min(h, 64) + 2)] + [(spare, h + 1 + 2 * spare)]:
        k = max(0, h + 1 + 2 * e - m)
        if k > m or (e and k):
            continue
        size = low / m
        blanks = (m - k) * math.exp(-size) + k * math.exp(-size) * (1 + size)
        cost = m + k * (1 + high / m) + CROWD * _excess(blanks, e)
        if best is None or cost < best[0]:
            best = (cost, m, k, e)
    return best[1:]


def _excess(mean: float, e: int) -> float:
    """Expected number beyond ``e`` of a Poisson count."""
    chance, total = math.exp(-mean), mean - e
    for b in range(e):
        total += (e - b) * chance
        chance *= mean / (b + 1)
    return max(0.0, total)


def sets_of(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and the offsets of each."""
    h, at = shingles_of(texts, words)
    own = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
    offs = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in own], out=offs[1:])
    return (np.concatenate(own) if own else h), offs


def signatures(h: np.ndarray, offs: np.ndarray, up: bool, part: int = PART, whole: int = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each set in its own band, or (``up``) in the next one if a partner may be
    there: a flat array, offsets, and how many more each set may leave out."""
    n = len(offs) - 1
    size = np.diff(offs)
    table = np.array(bands(int(size.max(initial=1)) * whole // part + 2, part, whole), dtype=np.int64)
    band = np.searchsorted(table[:, 0], size, side="right") - 1
    if up:
        band = band + 1
        reach = size * whole // part
        use = (band < len(table)) & (size > 0)
        use[use] = reach[use] >= table[band[use], 0]
    else:
        use = size > 0
    band = np.where(use, band, 0)
    m, k, e = (np.where(use, table[band, c], 0) for c in (2, 3, 4))
    base = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(m, out=base[1:])
    doc = np.repeat(np.arange(n), size)
    inside = m[doc] > 0
    doc, x = doc[inside], h[inside]
    with np.errstate(over="ignore"):
        seg = ((mix64(x ^ _SEG) >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = base[doc] + seg
        g = mix64(x ^ _SUM)
        total = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(total, slot, g)
        filled = np.bincount(slot, minlength=int(base[-1]))
        owner = np.repeat(np.arange(n), m)
        within = np.arange(base[-1]) - base[owner]
        salt = mix64((band[owner] * (1 << 32) + within).astype(np.uint64) * _SALT)
        full = mix64(total + salt)
        blank = filled == 0
        seen = np.cumsum(blank)
        rank = seen - np.concatenate([[0], seen])[base[owner]]  # the how manieth blank of its set
        out = blank & (rank <= e[owner])
        left = e - np.bincount(owner[out], minlength=n)
        near = seg < k[doc]
        fewer = mix64(total[slot[near]] - g[near] + salt[slot[near]])
    sig = np.concatenate([full[~out], fewer])
    of = np.concatenate([owner[~out], doc[near]])
    order = np.argsort(of, kind="stable")
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(of, minlength=n), out=at[1:])
    return sig[order], at, left


def _keys(h: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set; none for an empty one."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ s))]) for s in (_KEY1, _KEY2)]
        parts = [s[offs[1:]] - s[offs[:-1]] for s in sums]
    raw = np.column_stack(parts).astype("<u8").tobytes()
    return [raw[16 * i:16 * i + 16] if a < b else None for i, (a, b) in enumerate(zip(offs[:-1], offs[1:]))]


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


#: Bits of a set's parity map, and the largest segment whose members are all held against each other.
BITS, SMALL = 2048, 8


def _parity(h: np.ndarray, offs: np.ndarray) -> pa.Array:
    """For each set, a map of the parities of how many elements fall on each bit. Bits in which
    two maps differ are at most the elements in which the sets differ."""
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    bit = (mix64(h ^ _KEY2) >> np.uint64(53)).astype(np.int64)
    odd = (np.bincount(doc * BITS + bit, minlength=n * BITS) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (BITS // 64), pa.int32()), pa.array(words, pa.int64()))


def _only_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and node, one for each node of those signatures that
    several nodes have; a batch and a row are in memory."""
    held = None
    first = None  # signature of the row before the held ones, once it is known to be another node's
    for b in batches:
        if not b.num_rows:
            continue
        held = b if held is None else pa.concat_batches([held, b])
        sig, node = held.column("sig").to_numpy(), held.column("node").to_numpy()
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        held = held.filter(pa.array(new))
        sig = sig[new]
        same = np.zeros(len(sig) + 1, dtype=bool)
        same[0] = first is not None and first == sig[0]
        same[1:-1] = sig[1:] == sig[:-1]
        keep = (same[:-1] | same[1:])[:-1]  # the last row waits for the next batch
        yield held.slice(0, len(sig) - 1).filter(pa.array(keep))
        if len(sig) > 1:
            first = int(sig[-2])
        held = held.slice(len(sig) - 1)
    if held is not None and first is not None and first == held.column("sig")[0].as_py():
        yield held


def _bounds(part: int, whole: int) -> tuple[str, str, str]:
    """SQL: bits in which two parity maps differ, the most in which linked sets can, and whether the
    elements that two members ``a`` and ``b`` share with others are enough for a link."""
    return ("aggregate(zip_with({0}, {1}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)",
            f"({{0}} + {{1}} - 2 * ceil({part} * ({{0}} + {{1}}) / {part + whole}))",
            f"{whole + part} * least(a.n - a.u, b.n - b.u) >= {part} * (a.n + b.n)")


def _candidates(docs: DataFrame, words: int, part: int, whole: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All rows with the digests of their sets; the pairs of small segments that the bounds allow;
    the members of large ones; the whole sets of both."""
    ship_package(docs.sparkSession)
    rows = id_text(docs)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, offs = sets_of([t.encode() for t in b.column("text").to_pylist()], words)
            keys = _keys(h, offs)
            yield pa.record_batch([
                b.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(keys, pa.binary()),
                pa.array([k and int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), _parity(h, offs)],
                ["doc_id", "n", "key", "node", "bits"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a set that the task has entered already isn't entered again
        for b in slices(batches):
            h, offs = sets_of([t.encode() for t in b.column("text").to_pylist()], words)
            keys = _keys(h, offs)
            if len(seen) > 200_000:
                seen.clear()
            new = [k is not None and not (k in seen or seen.add(k)) for k in keys]
            node = np.array([int.from_bytes(k[:8], "little", signed=True) if k else 0 for k in keys], dtype=np.int64)
            for up in (False, True):
                sig, at, left = signatures(h, offs, up, part, whole)
                n = np.diff(at)
                use = np.repeat(np.array(new, dtype=bool), n)
                yield pa.record_batch([pa.array(sig.view(np.int64)[use], pa.int64()), pa.array(np.repeat(node, n)[use], pa.int64()),
                                       pa.array(np.full(int(use.sum()), up), pa.bool_()),
                                       pa.array(np.repeat(left, n)[use], pa.int32())], ["sig", "node", "up", "left"])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, offs = sets_of([t.encode() for t in b.column("text").to_pylist()], words)
            right = pa.array([k == w for k, w in zip(_keys(h, offs), b.column("key").to_pylist())])
            yield pa.record_batch([b.column("node"), pa.array(np.diff(offs), pa.int64()), _lists(h, offs)], ["node", "n", "s"]).filter(right)

    indexed = save(rows.mapInArrow(index, "doc_id long, n long, key binary, node long, bits array<long>"), "join-index")
    entry = "sig long, node long, up boolean, left int"
    met = save(rows.mapInArrow(enter, entry).repartition("sig").sortWithinPartitions("sig", "node")
               .mapInArrow(_only_shared, entry), "join-met")

    # each set leaves out its most crowded segments, as many as it may
    crowd = met.groupBy("sig").agg(F.count("*").alias("c"))
    crowded = met.join(crowd.where("c > 4"), "sig").where("left > 0")
    spared = (crowded.withColumn("r", F.row_number().over(Window.partitionBy("node", "up").orderBy(F.desc("c"), "sig")))
              .where("r <= left").select("sig", "node", "up"))
    entered = met.join(spared, ["sig", "node", "up"], "left_anti").select("sig", "node").distinct()
    entered = save(entered, "join-entered")
    count = save(entered.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "join-counts")

    # small segments: all their pairs, held against the bounds by sizes and parity maps
    few = entered.join(count.where(f"c <= {SMALL}"), "sig").select("sig", "node")
    pairs = (few.alias("a").join(few.alias("b"), "sig").where("a.node < b.node")
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "join-wanted")
    maps = save(indexed.select("node", "n", "bits").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "join-maps")
    differ, apart, _ = _bounds(part, whole)
    near = (pairs.join(maps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
            .join(maps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
            .where(f"{whole} * least(na, nb) >= {part} * greatest(na, nb)")
            .where(f"{differ.format('ba', 'bb')} <= {apart.format('na', 'nb')}"))
    close = save(near.select("a", "b"), "join-close")

    # whole sets of all that a pair or a large segment still needs, from one text each
    large = entered.join(count.where(f"c > {SMALL}"), "sig").select("sig", "node")
    large = save(large, "join-large")
    members_of = large.select("node").distinct()
    need = save(close.select(F.explode(F.array("a", "b")).alias("node")).unionAll(members_of).distinct(), "join-need")
    told = save(indexed.select("doc_id", "key", "node").join(need, "node", "left_semi")
                .groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("x"))
                .select("node", "x.doc_id", "x.key"), "join-told")
    # a repeated doc_id has several texts, so the digest decides which one is meant
    # texts move once, by doc_id, at every size: the ids asked for grow with the corpus
    fetched = rows.join(told.hint("merge"), rows["doc_id"].eqNullSafe(told["doc_id"])).select("node", "key", "text")
    sets = save(fetched.mapInArrow(whole_sets, "node long, n long, s array<long>"), "join-sets")

    # u: elements that no other member of a large segment has; too many, and it links with none of them
    alive = members_of
    for _ in range(2):
        left = sets.join(alive, "node", "left_semi")
        lone = (left.select("node", F.explode("s").alias("x")).groupBy("x")
                .agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").groupBy("node")
                .agg(F.count("*").alias("u")))
        bounded = save(left.select("node", "n").join(lone, "node", "left")
                       .select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))
                       .where(f"{whole} * (n - u) >= {part} * n"), "join-alive")
        alive = bounded.select("node")
    return indexed, close, save(large.join(bounded, "node"), "join-members"), sets


def jaccard_components(docs: DataFrame, words: int = 4, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    indexed, close, members, sets = _candidates(docs, words, part, whole)
    differ, apart, may = _bounds(part, whole)
    pivot = (members.groupBy("sig").agg(F.min(F.struct("u", "node", "n")).alias("p"), F.count("*").alias("c"))
             .where("c > 1").select("sig", "p.node", "p.n", "p.u"))
    star = save(members.alias("a").join(pivot.alias("b"), "sig").where(f"a.node <> b.node AND {may}")
                .select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "join-star")
    links = save(_verified(close.unionAll(star).distinct(), sets, part, whole), "join-links")
    labels = components(links)
    # large segments that still hold several components: all pairs between them that the bounds allow
    marked = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    open_ = save(marked.join(mixed, "sig", "left_semi"), "join-open")
    held = indexed.select("node", "bits").join(open_.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    open_ = open_.join(held, "node")
    may = f"{may} AND {differ.format('a.bits', 'b.bits')} <= {apart.format('a.n', 'b.n')}"
    rest = (open_.alias("a").join(open_.alias("b"), "sig").where(f"a.node < b.node AND a.label <> b.label AND {may}")
            .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    more = save(_verified(rest, sets, part, whole), "join-more")
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    return _named(indexed.select("doc_id", "n", "node"), labels)


def jaccard_links(docs: DataFrame, words: int = 4, part: int = PART, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """All links between distinct sets, ``(a, b, doc_a, doc_b, copies_a, copies_b)`` with ``a < b`` digests and
    ``doc_a``, ``doc_b`` the smallest ids of the rows with these sets; and of every row
    ``(doc_id, n_shingles, component_id, n_links)``, ``n_links`` the number of other rows it links with."""
    indexed, close, members, sets = _candidates(docs, words, part, whole)
    differ, apart, may = _bounds(part, whole)
    # members of large segments: all pairs that the bounds allow, each once however many segments it shares
    pairs = (members.alias("a").join(members.alias("b"), "sig").where(f"a.node < b.node AND {may}")
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct())
    maps = save(indexed.select("node", "bits").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "links-maps")
    near = (pairs.join(maps.select(F.col("node").alias("a"), F.col("bits").alias("ba")), "a")
            .join(maps.select(F.col("node").alias("b"), F.col("bits").alias("bb")), "b")
            .where(f"{differ.format('ba', 'bb')} <= {apart.format('na', 'nb')}").select("a", "b"))
    links = save(_verified(close.unionAll(near).distinct(), sets, part, whole), "links")
    # equal sets are one node that weighs as many rows
    nodes = save(indexed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "links-nodes")
    told = (links.join(nodes.select(F.col("node").alias("a"), F.col("doc").alias("doc_a"), F.col("copies").alias("copies_a")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("doc").alias("doc_b"), F.col("copies").alias("copies_b")), "b")
            .select("a", "b", "doc_a", "doc_b", "copies_a", "copies_b"))
    told = save(told, "links-told")
    others = (told.select(F.col("a").alias("node"), F.col("copies_b").alias("c"))
              .unionAll(told.select(F.col("b").alias("node"), F.col("copies_a").alias("c")))
              .groupBy("node").agg(F.sum("c").alias("c")))
    counts = (nodes.join(others, "node", "left")
              .select("node", (F.col("copies") - 1 + F.coalesce("c", F.lit(0))).alias("n_links")))
    rows = (indexed.select("doc_id", "n", "node").join(counts, "node", "left")
            .withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))))
    return told, _named(rows, components(links), "n_links")


def _named(rows: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, n_shingles, component_id, *more)`` of rows with a digest, by the labels of the digests."""
    marked = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = save(marked.select("doc_id", "n", "label", *more), "join-marked")
    names = marked.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return (marked.join(names, "label", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more))


def _verified(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs that link, decided on whole sets."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return with_b.where((whole + part) * common >= part * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END) AS s
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
"""

#: The same statement with the number of other documents that each one links with.
LINKS_SQL = ORACLE_SQL.replace("AS component_id\n", "AS component_id,\n       (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links\n")

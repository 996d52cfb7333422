"""Repeated passages by sparse suffix arrays.

A passage of fifty words holds forty neighbouring heads (hashes of eight words); the place of the
smallest is its anchor, the same in every occurrence. Only suffixes that begin at anchors are kept.

The kept suffixes are sorted by head and the words that follow. What a suffix shares with its neighbours in
this order is the most it shares with any other, so a match extends to the right that far and no
farther. Sorted again by head and the words before it, read leftwards, the neighbours tell how far a
match can extend to the left. Both orders compare 32 words by two bits of their hashes: words that differ
may pass for equal, so a length is never too small, and a suffix takes 36 bytes. Of the windows of
:data:`LEAST` words hung on an anchor those inside both extensions are left; these are compared by
their whole 64-bit hashes, which decides. So no neighbour is out of reach, whatever stands beside a passage
and however many texts have it.

Suffixes are dealt by ranges of (head, words, row), which splits heads and passages that many texts have; at
the edge of a range, where a neighbour lies in the next one, a match counts as long as can be. Equal
windows are read as a sorted stream, spread by their hashes: a task holds a batch and what one text
repeats, and a passage's windows go to many tasks. The first occurrence in order of ``doc_id`` (null last),
a digest and the place stays; all later ones in other texts are repeats. Overlapping windows of a text
form a span; spans that share a window, also by way of others, have one class.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded; null, empty and short texts
have no window and no row; a passage counts if a row with another id or text has it (repeats within a
text alone don't). Rows without ``doc_id`` take part under a null id. Words and windows are told apart
by 64-bit hashes. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlake.llm.common import id_text, save, ship_package, slices
from envlake.llm.graph import components
from envlake.llm.vec import join_texts, mix64, shingles, word_hashes, word_spans

LEAST = 50
HEAD, WINDOW = 8, 40
#: Words beside a head that the orders compare, at two bits each, and those that a window can hold.
COMPARED, CONTEXT = 32, LEAST - HEAD
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: word hashes, first word of each text, and of each run of ``WINDOW`` heads inside a
    text its first word, its anchor (both in words of all texts) and the hash of the anchor's head."""
    data, offs = join_texts(texts)
    starts, ends, first = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    n = len(words) - HEAD + 1
    if n < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return words, first, none, none, np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    head, _ = shingles(words, np.array([0, len(words)]), HEAD)  # across texts too; those are left out below
    # the place of the smallest of WINDOW heads, by doubling (leftmost of equals)
    at, width = np.arange(n), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(head[b] < head[a], b, a)
    while 2 * width <= WINDOW:
        at = lower(at[:len(at) - width], at[width:])
        width *= 2
    if width < WINDOW:
        at = lower(at[:len(at) - (WINDOW - width)], at[WINDOW - width:])
    whole = np.flatnonzero(doc[:len(at)] == doc[np.arange(len(at)) + WINDOW + HEAD - 2])
    return words, first, whole, at[whole], head[at[whole]]


def _windows(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``LEAST`` words, from those of 32, 16 and 2."""
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        with np.errstate(over="ignore"):
            return mix64(a[:n] * _LEFT + b[:n] * _RIGHT + _LEFT)
    runs, width = {1: words}, 1
    while width < 32:
        runs[2 * width] = pair(runs[width], runs[width][width:])
        width *= 2
    return pair(pair(runs[32], runs[16][32:]), runs[2][48:])


def _contexts(words: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each of the words after the heads at ``at``, and of those before them leftwards, each packed into
    one integer, nearest word first. Beyond a text's ends the bits are the neighbouring texts': windows end there anyway."""
    bits = np.concatenate([np.zeros(COMPARED, np.uint64), words >> np.uint64(62), np.zeros(COMPARED + HEAD, np.uint64)])
    right, left = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for k in range(COMPARED):
        right = (right << np.uint64(2)) | bits[at + COMPARED + HEAD + k]
        left = (left << np.uint64(2)) | bits[at + COMPARED - 1 - k]
    return right, left


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that two packed contexts share; all that a window can hold where they are equal throughout."""
    differ = np.unpackbits((a ^ b).astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.where(differ.any(axis=1), differ.argmax(axis=1) // 2, CONTEXT)


def _extended(batches: Iterator[pa.RecordBatch], side: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From suffixes sorted by head and context ``side``: rows with the number of words of the context that they
    share with a neighbour of the same head (-1 without one); all that can be at the edges of the stream. A batch is
    in memory, and the row before it."""
    held, carry = None, CONTEXT
    for b in batches:
        held = b if held is None else pa.concat_batches([held, b])
        if held.num_rows < 2:
            continue
        g, words = held.column("g").to_numpy(), held.column(side).to_numpy()
        common = np.where(g[1:] == g[:-1], _common(words[1:], words[:-1]), -1)
        yield held.slice(0, held.num_rows - 1), np.maximum(np.concatenate([[carry], common[:-1]]), common)
        held, carry = held.slice(held.num_rows - 1), int(common[-1])
    if held is not None:
        yield held, np.full(held.num_rows, CONTEXT)


def _right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose head occurs elsewhere, with how far a match can extend to the right."""
    for b, common in _extended(batches, "right"):
        some = pa.array(common >= 0)
        yield pa.RecordBatch.from_arrays([*(b.column(c).filter(some) for c in ("g", "left", "row", "place")),
                                          pa.array(common, pa.int32()).filter(some)], ["g", "left", "row", "place", "reach"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes with room for a window between both extensions: where it can start, first and last."""
    for b, common in _extended(batches, "left"):
        place, reach = b.column("place").to_numpy(), b.column("reach").to_numpy()
        some = pa.array((common >= 0) & (common + reach >= CONTEXT))
        yield pa.RecordBatch.from_arrays([b.column("row").filter(some), b.column("place").filter(some), pa.array(place - common, pa.int32()).filter(some),
                                          pa.array(place + HEAD + reach - LEAST, pa.int32()).filter(some)], ["row", "place", "least", "most"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by window, id and row, those of windows that several rows have, each with the
    first occurrence; a batch and what the first row has of a window are in memory."""
    held = first = None  # first: window, row and place of the run that the held rows go on with
    for b in batches:
        if not b.num_rows:
            continue
        held = b if held is None else pa.concat_batches([held, b])
        w, row = held.column("w").to_numpy(), held.column("row").to_numpy()
        place = held.column("place").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        end = np.append(begin[1:], len(w))
        first_row, first_place = row[begin], place[begin]
        if first is not None and first[0] == w[0]:
            first_row[0], first_place[0] = first[1:]
        several = row[end - 1] != first_row
        if first is not None and first[0] == w[0]:
            several[0] = True
        run = np.repeat(np.arange(len(begin)), end - begin)
        keep = several[run]
        yield pa.record_batch([
            held.column("doc_id").filter(pa.array(keep)), pa.array(row[keep]), pa.array(place[keep]),
            pa.array(first_row[run][keep]), pa.array(first_place[run][keep])], ["doc_id", "row", "place", "first_row", "first_place"])
        first = (w[-1], first_row[-1], first_place[-1]) if several[-1] else None
        held = None if several[-1] else held.slice(int(begin[-1]))


def _unions(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of what windows at sorted places cover; those that touch form one."""
    if not len(place):
        return place, place
    new = np.flatnonzero(np.concatenate([[True], place[1:] > place[:-1] + LEAST]))
    return place[new], place[np.append(new[1:], len(place)) - 1] + LEAST


def _structs(rows: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Array:
    """A list column of structs from each row's fields."""
    at = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])])
    flat = [pa.array(np.concatenate([r[k] for r in rows]).astype(np.int64), pa.int64()) for k in range(len(names))]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(flat, list(names)))


def _spans(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Of each row, the spans of its windows, those that are repeats, and for each stretch of windows
    that go on side by side with their first occurrences one link; so many rows at a time."""
    for b in (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows)):
        spans, repeats, links = [], [], []
        for own, found in zip(b.column("row").to_pylist(), b.column("found")):
            place, first_row, first_place = (found.values.field(c).to_numpy().astype(np.int64) for c in ("place", "first_row", "first_place"))
            order = np.argsort(place)
            place, first_row, first_place = place[order], first_row[order], first_place[order]
            start, end = _unions(place)
            spans.append((start, end))
            repeats.append(_unions(place[first_row != own]))
            new = np.ones(len(place), dtype=bool)
            new[1:] = (first_row[1:] != first_row[:-1]) | (first_place[1:] != first_place[:-1] + 1) | (place[1:] != place[:-1] + 1)
            links.append((start[np.searchsorted(start, place[new], side="right") - 1], first_row[new], first_place[new]))
        yield pa.record_batch([b.column("doc_id"), b.column("row"), _structs(spans, ("start", "end")), _structs(repeats, ("start", "end")),
                               _structs(links, ("start", "first_row", "first_place"))], ["doc_id", "row", "spans", "repeats", "links"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each text with a repeated passage: ``(doc_id, spans, n_repeated_words, repeats)``.
    ``spans`` are maximal runs of words ``(start, end, class_id)``, end exclusive; ``class_id`` is the same for all
    spans that share windows, also by way of others. ``repeats`` are the runs ``(start, end)`` to remove if the
    first occurrence of each window stays (none where all of a text's are first ones)."""
    found = save(_passages(docs), "passages")
    # a window's first occurrence is a node that all spans with it link to; the span it lies in does too
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.start", "s.end", F.xxhash64("row", "s.start").alias("node"))
    links = save(found.select("row", F.explode("links").alias("l")).select("row", "l.*"), "passage-links")
    target = F.xxhash64("first_row", "first_place", F.lit(1)).alias("b")
    own = (links.select("first_row", "first_place").distinct().join(spans.withColumnRenamed("row", "first_row"), "first_row")
           .where("start <= first_place AND first_place < end").select(F.col("node").alias("a"), target))
    labels = components(links.select(F.xxhash64("row", "start").alias("a"), target).unionAll(own))
    classes = (spans.join(labels, "node").groupBy("row")
               .agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("label").alias("class_id")))).alias("classes")))
    return (found.join(classes, "row")
            .select("doc_id", F.col("classes").alias("spans"),
                    F.expr("aggregate(classes, 0L, (a, x) -> a + x.end - x.start)").alias("n_repeated_words"), "repeats"))


def _passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, spans, repeats, links)`` of each text with a repeated passage."""
    ship_package(docs.sparkSession)
    # rows are told apart by a digest, so that rows sharing a doc_id or without one keep their own spans
    rows = id_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words, first, _, anchor, head = anchors([t.encode() for t in b.column("text").to_pylist()])
            at, which = np.unique(anchor, return_index=True)
            doc = np.searchsorted(first, at, side="right") - 1
            right, left = _contexts(words, first, at)
            yield pa.record_batch([*(pa.array(x.view(np.int64), pa.int64()) for x in (head[which], right, left)), b.column("row").take(pa.array(doc)),
                                   pa.array(at - first[doc], pa.int32())], ["g", "right", "left", "row", "place"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.mapInArrow(suffixes, "g long, right long, left long, row long, place int")
    by_right = (save(kept, "suffixes").repartitionByRange(n, "g", "right", "row", "place").sortWithinPartitions("g", "right", "row", "place")
                .mapInArrow(_right, "g long, left long, row long, place int, reach int"))
    by_left = (save(by_right, "suffixes-right").repartitionByRange(n, "g", "left", "row", "place").sortWithinPartitions("g", "left", "row", "place")
               .mapInArrow(_left, "row long, place int, least int, most int"))
    # places of a text: bounded by its length
    places = by_left.groupBy("row").agg(F.collect_set(F.struct("place", "least", "most")).alias("places"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words, first, start, anchor, _ = anchors([t.encode() for t in b.column("text").to_pylist()])
            if not len(start):
                continue
            least, most = np.full(len(words), 1 << 40), np.full(len(words), -1)
            for low, found in zip(first.tolist(), b.column("places")):
                place, from_, to = (found.values.field(c).to_numpy().astype(np.int64) for c in ("place", "least", "most"))
                least[low + place], most[low + place] = low + from_, low + to
            doc = np.searchsorted(first, start, side="right") - 1
            use = (least[anchor] <= start) & (start <= most[anchor]) & (start + LEAST <= first[doc + 1])
            start, doc = start[use], doc[use]
            if not len(start):
                continue
            yield pa.record_batch([
                pa.array(_windows(words)[start].view(np.int64), pa.int64()), b.column("doc_id").take(pa.array(doc)),
                b.column("row").take(pa.array(doc)), pa.array(start - first[doc], pa.int32())], ["w", "doc_id", "row", "place"])
    windows = rows.join(places, "row").mapInArrow(expand, "w long, doc_id long, row long, place int")
    found = (windows.repartition("w").sortWithinPartitions("w", F.asc_nulls_last("doc_id"), "row", "place")
             .mapInArrow(_shared, "doc_id long, row long, place int, first_row long, first_place int"))
    # windows of a text: bounded by its length
    each = found.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.collect_set(F.struct("place", "first_row", "first_place")).alias("found"))
    pair = "array<struct<start:bigint,end:bigint>>"
    return each.mapInArrow(_spans, f"doc_id long, row long, spans {pair}, repeats {pair}, "
                                   "links array<struct<start:bigint,first_row:bigint,first_place:bigint>>")

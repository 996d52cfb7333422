"""Byte-level BPE encoding and decoding without a regex engine.

Pre-tokenisation follows ``public_tokenizers.PATTERN``. Each code point becomes a class symbol
(with the look-ahead it needs folded in), each symbol a transition function over the eight
states of a small automaton, and the state before every code point comes from an associative
scan of function composition: within blocks side by side, then over the blocks. Where state and
symbol say that a token starts, the text is cut; the slices go to a cached pair merging by
rank. Offsets stay with the slices, so ids decode back to spans as well as to bytes.

Defined results: a null text is empty and has no ids; every code point of any text is covered.
Only ``doc_id`` and ``text`` are read; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from envlake.llm.common import id_text, ship_package, slices

# The white space of \s, and the contractions of the pattern by their length.
_WHITE = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_AFTER_ONE = "stmd"
_AFTER_TWO = ("re", "ve", "ll")

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE, BREAK = range(6)
# Symbols: classes with look-ahead. *_LAST: white space right before something else.
S_BREAK, S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_SPACE_LAST, S_SPACE_IN, S_WHITE_LAST, S_WHITE_IN = range(10)
# States: what the current token is. DONE: it has ended; LEAD: one space that the next token takes in.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, LEAD, IN_WHITE, WANT1, WANT2 = range(8)

#: Between texts: no code point, so it belongs to no text.
_GAP = 0x110000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this code point."""
    if symbol == S_BREAK:
        return DONE, True
    if symbol == S_LETTER:
        if state in (IN_LETTERS, LEAD):
            return IN_LETTERS, False
        if state in (WANT1, WANT2):
            return (DONE if state == WANT1 else WANT1), False
        return IN_LETTERS, True
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, LEAD)
    if symbol in (S_OTHER, S_QUOTE1, S_QUOTE2):
        if state in (IN_OTHERS, LEAD):
            return IN_OTHERS, False
        return {S_OTHER: IN_OTHERS, S_QUOTE1: WANT1, S_QUOTE2: WANT2}[symbol], True
    if symbol == S_SPACE_LAST:
        return LEAD, True
    if symbol == S_WHITE_LAST:
        return DONE, True
    return IN_WHITE, state != IN_WHITE


class _Automaton:
    """The transition functions closed under composition, with tables to compose and apply them."""

    def __init__(self) -> None:
        states, symbols = range(8), range(10)
        self.starts = np.array([[_step(s, c)[1] for c in symbols] for s in states])
        first = [tuple(_step(s, c)[0] for s in states) for c in symbols]
        known = {tuple(states): 0}
        queue = [tuple(states)]
        for f in queue:
            for g in first:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
        self.of_symbol = np.array([known[f] for f in first], dtype=np.int32)
        self.size = len(queue)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in queue] for f in queue],
                             dtype=np.int32).reshape(-1)
        self.from_done = np.array([f[DONE] for f in queue], dtype=np.int8)

    def states_before(self, symbols: np.ndarray, block: int = 64) -> np.ndarray:
        """The state before each symbol, by a two-level scan of composed functions."""
        n = len(symbols)
        rows = -(-n // block)
        f = np.zeros(rows * block, dtype=np.int32)
        f[:n] = self.of_symbol[symbols]
        f = np.ascontiguousarray(f.reshape(rows, block).T)
        for j in range(1, block):  # prefixes within all blocks at once
            f[j] = self.then[f[j - 1] * self.size + f[j]]
        ahead = self._exclusive(f[-1])
        state = np.empty((block, rows), dtype=np.int8)
        state[0] = self.from_done[ahead]
        for j in range(1, block):
            state[j] = self.from_done[self.then[ahead * self.size + f[j - 1]]]
        return state.T.reshape(-1)[:n]

    def _exclusive(self, f: np.ndarray) -> np.ndarray:
        """Composition of all functions before each one, by doubling."""
        out = np.zeros_like(f)
        out[1:] = f[:-1]
        step = 1
        while step < len(out):
            new = out.copy()
            new[step:] = self.then[out[:-step] * self.size + out[step:]]
            out = new
            step *= 2
        return out


_tables: dict = {}


def _classes() -> np.ndarray:
    if "classes" not in _tables:
        kind = np.full(_GAP + 1, OTHER, dtype=np.int8)
        for c in range(_GAP):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kind[c] = LETTER
            elif k == "N":
                kind[c] = NUMBER
        kind[list(_WHITE)] = WHITE
        kind[0x20] = SPACE
        kind[_GAP] = BREAK
        _tables["classes"], _tables["automaton"] = kind, _Automaton()
    return _tables["classes"]


def cuts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts with one character between them, the code-point offsets at which a token or such
    a character starts, and for each text the index of its first offset (then of the end)."""
    kind = _classes()
    joined = "\0".join(texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    cls = kind[code]
    cls[ends] = BREAK
    n = len(code)
    white = (cls == SPACE) | (cls == WHITE)
    more = np.zeros(n, dtype=bool)  # the next code point is white space, or there is none
    more[:-1] = white[1:] | (cls[1:] == BREAK)
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_SPACE_LAST, S_WHITE_LAST, S_BREAK], dtype=np.int8)[cls]
    symbol[white & more] += 1
    quote = np.flatnonzero(code == 0x27)
    if len(quote):
        for q in quote.tolist():
            if joined[q + 1] in _AFTER_ONE:
                symbol[q] = S_QUOTE1
            elif joined[q + 1:q + 3] in _AFTER_TWO:
                symbol[q] = S_QUOTE2
    a = _tables["automaton"]
    at = np.flatnonzero(a.starts[a.states_before(symbol), symbol])
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    first[1:] = np.searchsorted(at, ends) + 1
    return joined, at, first


class Codec:
    """Ranks, a cache of merged slices, and the way back from ids to bytes."""

    #: Slices kept; the cache starts anew beyond, so its memory is bounded.
    KEEP = 500_000

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        """One codec for each process and file."""
        if path not in _tables:
            _tables[path] = cls(path)
        return _tables[path]

    def merged(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= self.KEEP:
                self.cache.clear()
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else self._merge(raw)
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids

    def _merge(self, raw: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank (leftmost on ties) until none has a rank."""
        ranks = self.ranks
        parts = [raw[i:i + 1] for i in range(len(raw))]
        if len(parts) <= 160:
            none = len(ranks)
            rank = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            while rank and (low := min(rank)) < none:
                i = rank.index(low)
                parts[i] += parts.pop(i + 1)
                del rank[i]
                if i < len(rank):
                    rank[i] = ranks.get(parts[i] + parts[i + 1], none)
                if i:
                    rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            return tuple([ranks[p] for p in parts])
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != r:
                continue  # one of the two has been merged meanwhile
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        if not texts:
            return []
        joined, at, first = cuts(texts)
        points = at.tolist()
        get, merged = self.cache.get, self.merged
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            ids: list[int] = []
            own = points[a:b]  # the last one is the character after the text
            for x, y in zip(own, own[1:]):
                piece = joined[x:y]
                ids += get(piece) or merged(piece)
            out.append(ids)
        return out

    def spans(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """Start, end (code points) and ids of each slice of one text."""
        joined, at, _ = cuts([text])
        points = at.tolist()
        return [(x, y, self.merged(joined[x:y])) for x, y in zip(points, points[1:])]

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


def encode_documents(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path)
        for b in slices(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array(codec.encode(b.column("text").to_pylist()),
                                                                pa.list_(pa.int32()))], ["doc_id", "ids"])
    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; ids that end within a character decode with U+FFFD."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path)
        for b in batches:
            texts = [codec.decode(ids or []).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode every text, decode its ids, and return counts and digests of both (no shuffle)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks_path)
        names = np.array([str(i) for i in range(len(codec.bytes_of))], dtype=object)
        for b in slices(batches, 1 << 18):
            found = codec.encode(b.column("text").to_pylist())
            yield pa.record_batch([
                b.column("doc_id"), pa.array([len(ids) for ids in found], pa.int64()),
                pa.array([hashlib.sha256(" ".join(names[ids]).encode()).hexdigest() if ids
                          else hashlib.sha256(b"").hexdigest() for ids in found]),
                pa.array([hashlib.sha256(codec.decode(ids)).hexdigest() for ids in found])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

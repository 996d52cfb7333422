"""Token ids in files of a binary format, coded by context mixing and a range coder.

Order 2 (the two ids before) and order 1 (the id before) each predict one id, the one that lately
followed there, with a confidence; how often a prediction of that confidence came true is counted as
the block goes. Weights that follow how well each order did mix these chances with order 0, and an
arithmetic (range) coder writes which of the two predictions held, or neither. In the latter case order
0 writes the id: its class (highest bit and the bit below) by adaptive counts, then its lower bits. The
coder's bytes are words of 20 bits, two in five bytes. A
block of :data:`BLOCK` ids starts from empty tables and carries a checksum, so any block can be read
alone. Blocks advance side by side as numpy lanes, :data:`LANES` at most: one step codes one id of every
block. A lane's tables, ids and words take 25 KB, so a task's stay near 100 MB however long a text is; its
ids themselves take 8 bytes each.

A section file holds whole documents in ascending ``doc_id`` order::

    "CMR3", then little-endian: u32 documents, u64 ids, u64 ids before it in its chunk, u32 blocks
    i64 doc_id and u8 known for each document, u32 ids for each document
    u32 bytes and u32 crc32 for each block, the blocks' bytes, u32 crc32 of all before

Defined results: a null or empty text has just the end id; rows that share an id are ordered by
text, rows without id come first; an empty table writes nothing. An id of 65,536 or more, or below 0, is an error:
the classes end there. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlake.llm.common import id_text, save, ship_package, slices, work_dir
from envlake.sources.files import _fs, qualified

BLOCK = 1024
#: Blocks coded side by side.
LANES = 4096
#: Ids after which a section ends with the current document.
SECTION = 1 << 22
_SLOTS = 1024
_CLASSES = 32
_ADD = 24  # BLOCK * _ADD plus the first counts stay below 2**15
_EVERY = 4  # ids after which counts come into force
_BITS = 12
_SURE = np.int16(4064)
#: The coder's width stays from 2**40 to 2**60 between ids. An id takes 7 bits of it at most for what held, 15 for the
#: counts and 14 for the lower bits, so something is always left; words of 20 bits leave once an id.
_SMALL, _FULL = np.uint64(1 << 40), np.uint64(1 << 60)
_LOW, _WORD, _TOP = np.uint64((1 << 40) - 1), np.uint64(20), np.uint64(40)


def _class_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id; number of lower bits and first id of each class."""
    base = np.array([0, 1] + [(2 + half) << (high - 1) for high in range(1, 16) for half in (0, 1)])
    rest = np.array([0, 0] + [high - 1 for high in range(1, 16) for _ in (0, 1)])
    return (np.searchsorted(base, np.arange(1 << 16), side="right") - 1).astype(np.uint8), rest.astype(np.uint64), base.astype(np.uint16)


_CLASS, _REST, _BASE = _class_tables()


class _Model:
    """Predictions of every lane. Tables lie flat, a row of lanes for each slot; arrays of both orders hold order
    2's lanes, then order 1's."""

    def __init__(self, n: int) -> None:
        self.n, self.lane, self.both = n, np.arange(n), np.arange(2 * n)
        self.follows = np.full(_SLOTS * 2 * n, 0, dtype=np.int32)  # predicted id, confidence << 16
        self.chance = np.repeat(np.array([0, 1024, 2048, 2560, 3072, 3328, 3584, 3712], dtype=np.int16), 2 * n)
        self.weight, self.rest = np.full(2 * n, 1024, dtype=np.int16), np.full(n, 1024, dtype=np.int16)
        self.upto = np.repeat(np.arange(_CLASSES + 1, dtype=np.uint16)[:, None] * 4, n, axis=1)
        self.steps = np.arange(_CLASSES + 1, dtype=np.uint8)[:, None]
        self.more, self.held_back = np.zeros((_CLASSES + 1, n), dtype=np.uint8), 0
        self.last = self.second = np.zeros(n, dtype=np.uint16)
        self.hash = np.zeros(2 * n, dtype=np.uint16)
        self.hit = np.zeros(2 * n, dtype=bool)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids predicted by order 2 and 1, and their mixed shares of 4096 (order 1 has none where both agree)."""
        n, two, one = self.n, self.hash[:self.n], self.hash[self.n:]
        np.multiply(self.last, np.uint16(60493), out=two)  # the lower 16 bits hold the slot's
        two += self.second * np.uint16(30011)
        two >>= np.uint16(5)
        np.multiply(self.last, np.uint16(40503), out=one)
        one >>= np.uint16(4)
        self.hash &= np.uint16(_SLOTS - 1)
        self.slot = self.hash.astype(np.int64)
        self.slot *= 2 * n
        self.slot += self.both
        entry = self.follows.take(self.slot)
        self.guess = entry.astype(np.uint16)
        entry >>= 16
        self.trust = entry.astype(np.int16)
        self.cell = entry.astype(np.int64)
        self.cell *= 2 * n
        self.cell += self.both
        self.own = self.chance.take(self.cell)
        total = (self.weight[:n] + self.weight[n:] + self.rest).astype(np.float32)
        mixed = self.weight.astype(np.float32)
        mixed *= self.own  # at most 2**24, so exact
        mixed[:n] /= total
        mixed[n:] /= total
        share = mixed.astype(np.uint16)
        both, lone = share[:n], share[n:]
        alone = lone * (self.guess[:n] != self.guess[n:])
        both += lone
        both -= alone
        return self.guess[:n], self.guess[n:], both, alone

    def learn(self, now: np.ndarray) -> None:
        n, hit, own, trust = self.n, self.hit, self.own, self.trust
        np.equal(self.guess[:n], now, out=hit[:n])
        np.equal(self.guess[n:], now, out=hit[n:])
        hit &= trust > 0
        held = -hit.view(np.int8).astype(np.int16)  # all bits where the prediction came true
        nowhere = ~(held[:n] | held[n:])
        # an order's weight goes to its chance if it held, the chance's rest if none did, or 16
        to = 4080 - own
        to[:n] &= nowhere
        to[n:] &= nowhere
        to += 16
        to ^= (to ^ own) & held
        to -= self.weight
        to >>= 5
        self.weight += to
        nowhere &= 4080
        nowhere += 16
        nowhere -= self.rest
        nowhere >>= 5
        self.rest += nowhere
        to = held & _SURE
        to -= own
        to >>= 4
        to += own
        self.chance[self.cell] = to
        # a prediction that held is trusted more, one that didn't half as much, and replaced at the least trust
        less = np.maximum(trust >> 1, 1)
        swap = (~held & ((trust - 2) >> 15)).view(np.uint16)
        less ^= (less ^ np.minimum(trust + 1, 7)) & held
        entry = less.astype(np.int32)
        entry <<= 16
        self.guess[:n] ^= (self.guess[:n] ^ now) & swap[:n]
        self.guess[n:] ^= (self.guess[n:] ^ now) & swap[n:]
        entry |= self.guess
        self.follows[self.slot] = entry
        self.second, self.last = self.last, now

    def share(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's class begins among the counts, and its count."""
        at = kind * np.int64(self.n) + self.lane
        flat = self.upto.reshape(-1)
        start = flat.take(at)
        return start.astype(np.uint64), (flat.take(at + self.n) - start).astype(np.uint64)

    def count(self, kind: np.ndarray, wrote: np.ndarray) -> None:
        self.more += (self.steps > (kind | ~wrote * np.uint8(_CLASSES))).view(np.uint8)
        self.held_back += 1
        if self.held_back == _EVERY:
            self.upto += self.more * np.uint16(_ADD)
            self.more[:], self.held_back = 0, 0


def compress(ids: np.ndarray) -> list[bytes]:
    """The bytes of each block of ids (the last one filled up with zeros); ValueError for ids outside [0, 65536)."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) > 0xFFFF):
        raise ValueError(f"ids from {ids.min()} to {ids.max()}: only 0 to 65535 can be coded")
    step = LANES * BLOCK
    return [b for i in range(0, len(ids), step) for b in _compress(ids[i:i + step])]


def _compress(ids: np.ndarray) -> list[bytes]:
    n, steps = -(-len(ids) // BLOCK), min(BLOCK, len(ids))
    rows = np.zeros(n * BLOCK, dtype=np.uint16)
    rows[:len(ids)] = ids
    rows = np.ascontiguousarray(rows.reshape(n, BLOCK).T)
    model = _Model(n)
    low, width = np.zeros(n, dtype=np.uint64), np.full(n, _FULL)
    words = np.zeros((3 * steps + 4) * n, dtype=np.uint32)  # 20 bits each, and a carry
    at = np.arange(n)  # where each lane's next word goes
    for t in range(steps):
        now = rows[t]
        two_id, one_id, two, one = model.predict()
        first = (two_id == now) & (two > 0)
        next_ = (one_id == now) & (one > 0)
        wrote = ~(first | next_)
        width >>= np.uint64(_BITS)
        low += width * (two * ~first + one * wrote).astype(np.uint64)
        width *= (two * first + one * next_ + (np.uint16(4096) - two - one) * wrote).astype(np.uint64)
        kind = _CLASS.take(now)
        start, size = model.share(kind)
        step = width // model.upto[_CLASSES]
        start *= wrote
        low += step * start
        step *= size
        width ^= (width ^ step) * wrote
        width >>= _REST.take(kind) * wrote
        low += width * ((now - _BASE.take(kind)) * wrote).astype(np.uint64)
        model.count(kind, wrote)
        model.learn(now)
        who = np.flatnonzero(width < _SMALL)
        while len(who):
            own, to, wide = low.take(who), at.take(who), width.take(who) << _WORD
            words[to] = own >> _TOP
            low[who] = (own & _LOW) << _WORD
            width[who] = wide
            at[who] = to + n
            who = who[wide < _SMALL]
    for _ in range(3):
        words[at] = low >> _TOP
        low = (low & _LOW) << _WORD
        at += n
    lines = words.reshape(-1, n)[:int(at.max()) // n + 1]  # one more, for pairs
    for i in range(len(lines) - 1, 0, -1):
        lines[i - 1] += lines[i] >> np.uint32(20)
    lines &= np.uint32(0xFFFFF)
    n_pairs = len(lines) // 2
    pairs = lines[0:2 * n_pairs:2].T | lines[1:2 * n_pairs:2].T.astype("<u8") << _WORD
    whole = np.ascontiguousarray(pairs).view(np.uint8).reshape(n, n_pairs, 8)[:, :, :5].reshape(n, -1)
    return [whole[i, :-(-5 * k // 2)].tobytes() for i, k in enumerate((at // n).tolist())]


def expand(blocks: list[bytes], n_ids: int) -> np.ndarray:
    """The ids that :func:`compress` was given."""
    parts = [_expand(blocks[i:i + LANES], min(n_ids - i * BLOCK, LANES * BLOCK)) for i in range(0, len(blocks), LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _expand(blocks: list[bytes], n_ids: int) -> np.ndarray:
    n, steps = len(blocks), min(BLOCK, n_ids)
    n_pairs = -(-max(map(len, blocks)) // 5) + 2
    pairs = np.zeros((n, n_pairs, 8), dtype=np.uint8)
    for i, b in enumerate(blocks):
        pairs[i, :-(-len(b) // 5), :5] = np.frombuffer(b + bytes(-len(b) % 5), dtype=np.uint8).reshape(-1, 5)
    pairs = pairs.view("<u8").reshape(n, n_pairs).T
    words = np.empty((n_pairs, 2, n), dtype=np.uint32)
    words[:, 0], words[:, 1] = pairs & np.uint64(0xFFFFF), pairs >> _WORD
    words, at = words.reshape(-1), np.arange(n) + 3 * n
    left = (words[:n].astype(np.uint64) << _TOP) | (words[n:2 * n].astype(np.uint64) << _WORD) | words[2 * n:3 * n]
    width = np.full(n, _FULL)
    model = _Model(n)
    rows = np.zeros((BLOCK, n), dtype=np.uint16)
    for t in range(steps):
        two_id, one_id, two, one = model.predict()
        both = two + one
        width >>= np.uint64(_BITS)
        value = np.minimum(left // width, np.uint64(4095)).astype(np.uint16)
        first, wrote = value < two, value >= both
        next_ = ~(first | wrote)
        left -= width * (two * ~first + one * wrote).astype(np.uint64)
        width *= (two * first + one * next_ + (np.uint16(4096) - both) * wrote).astype(np.uint64)
        total = model.upto[_CLASSES]
        step = width // total
        value = np.minimum(left // step, total - np.uint16(1)).astype(np.uint16)
        kind = np.add.reduce((model.upto[1:] <= value).view(np.uint8), axis=0, dtype=np.uint8)
        start, size = model.share(kind)
        start *= wrote
        left -= step * start
        step *= size
        width ^= (width ^ step) * wrote
        width >>= _REST.take(kind) * wrote
        value = left // width * wrote
        left -= value * width
        now = two_id * first + one_id * next_ + (_BASE.take(kind) + value.astype(np.uint16)) * wrote
        rows[t] = now
        model.count(kind, wrote)
        model.learn(now)
        who = np.flatnonzero(width < _SMALL)
        while len(who):
            to, wide = at.take(who), width.take(who) << _WORD
            left[who] = (left.take(who) << _WORD) | words.take(to)
            width[who] = wide
            at[who] = to + n
            who = who[wide < _SMALL]
    return rows.T.reshape(-1)[:n_ids].astype(np.int64)


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    """A section file."""
    blocks = compress(ids)
    body = b"".join([
        b"CMR3", struct.pack("<IQQI", len(doc_ids), len(ids), before, len(blocks)),
        np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(), np.array([i is not None for i in doc_ids], dtype=np.uint8).tobytes(),
        np.array(lengths, dtype="<u4").tobytes(), np.array([len(b) for b in blocks], dtype="<u4").tobytes(),
        np.array([zlib.crc32(b) for b in blocks], dtype="<u4").tobytes(), *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """``(doc_ids, lengths, ids, ids before in the chunk)`` of a section file; a checksum that
    doesn't hold raises ValueError."""
    if raw[:4] != b"CMR3" or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a section file, or damaged")
    n_docs, n_ids, before, n_blocks = struct.unpack_from("<IQQI", raw, 4)
    at = 28
    take = lambda kind, n: np.frombuffer(raw, dtype=kind, count=n, offset=at)
    doc_ids = take("<i8", n_docs)
    at += 8 * n_docs
    known = take(np.uint8, n_docs)
    at += n_docs
    lengths = take("<u4", n_docs)
    at += 4 * n_docs
    sizes = take("<u4", n_blocks)
    at += 4 * n_blocks
    sums = take("<u4", n_blocks)
    at += 4 * n_blocks
    blocks = []
    for size, crc in zip(sizes.tolist(), sums.tolist()):
        blocks.append(raw[at:at + size])
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {len(blocks) - 1} is damaged")
        at += size
    return [i if k else None for i, k in zip(doc_ids.tolist(), known.tolist())], lengths, expand(blocks, n_ids), before


#: Bytes of text encoded at a time; a longer text is encoded alone.
TEXT_BYTES = 1 << 24
#: Strings whose ids a worker remembers, and the length from which one is not remembered.
REMEMBERED, LONG_WORD = 1 << 20, 64
_libraries: dict[str, object] = {}
#: Below this code point all characters have their classes since Unicode 5, so that any library agrees on them.
_KNOWN = 0x250
_FAR = re.compile(f"[^\0-{chr(_KNOWN - 1)}]")
_LETTERS, _NUMBERS = ("".join(c for c in map(chr, range(_KNOWN)) if unicodedata.category(c)[0] == kind) for kind in "LN")
_SIGNS, _BLANKS = string.punctuation, "\t\n\v\f\r \x85\xa0"
#: Fixed values of byte-level pre-tokenisation: its pieces, and how it shows the bytes that can't be seen.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_LETTERS}{_NUMBERS}{_BLANKS}]+"
                     f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
_VISIBLE = np.arange(256, dtype="<u2")
_VISIBLE[[*range(33), *range(127, 161), 173]] = 256 + np.arange(68)
_BLANK, _NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
_GAP = r" (?:[\s\x1c-\x1f\x85\p{Z}]|$)"


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class _Memory:
    """Ids of strings seen before, in Arrow arrays: strings and ids have no objects of their own."""

    def __init__(self) -> None:
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def get(self, texts: pa.Array, ask: Callable[[pa.Array], list[bytes]]) -> pa.Array:
        """Ids of each text; each distinct new one is asked for once."""
        coded = texts.cast(pa.large_string()).dictionary_encode()
        # a lookup hashes what it looks in, so a few texts look among the latest strings only
        base = max(0, len(self.known) - 8 * len(coded.dictionary))
        at = pc.index_in(coded.dictionary, self.known.slice(base))
        new = coded.dictionary.filter(at.is_null())
        ids = pa.concat_arrays([self.ids, pa.array(ask(new) if len(new) else [], pa.large_binary())])
        is_new = at.is_null().to_numpy(zero_copy_only=False)
        at = np.where(is_new, len(self.known) + np.cumsum(is_new) - 1, at.fill_null(0).to_numpy().astype(np.int64) + base)
        found = ids.take(pa.array(at).take(coded.indices))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, ids = self.known.slice(0, 0), ids.slice(len(self.known))
        keep = pc.less(pc.binary_length(new), LONG_WORD)
        if not pc.all(keep).as_py():
            ids = pa.concat_arrays([ids.slice(0, len(self.known)), ids.slice(len(self.known)).filter(keep)])
            new = new.filter(keep)
        self.known = pa.concat_arrays([self.known, new])
        self.ids = ids if len(ids) else pa.array([], pa.large_binary())
        return found


class TextEncoder:
    """Ids of whole texts by the ``tokenizers`` library, which is asked once for each distinct word.

    With byte-level pre-tokenisation a piece never reaches over a space that a visible character follows, so
    a text without other spaces is cut at its spaces and the ids are joined; ids of words seen before come from a
    bounded memory that the tasks of a worker share. Latin words are cut into pieces, and each new piece goes to the
    library's model once; other new words go through the whole library. Other texts, and all with any other set-up
    of the library, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        """The library and the memories are made once in a worker."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel
        if path not in _libraries:
            _libraries[path] = Tokenizer.from_file(path), _Memory(), _Memory()
        self.library, self.pieces, self.words = _libraries[path]
        self.library.encode_special_tokens = True
        pre = self.library.pre_tokenizer
        self.by_word = (isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space
                        and isinstance(self.library.model, BPE) and self.library.normalizer is None
                        and all(t.special for t in self.library.get_added_tokens_decoder().values()))
        self.tokenize = self.library.model.tokenize

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, pieces: pa.Array) -> list[bytes]:
        """Ids of pieces by the library's model."""
        # byte 255 is in no UTF-8 and shown as itself
        raw = "\udcff".join(_strings(pieces)).encode("utf-8", "surrogateescape")
        shown = _VISIBLE[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-16-le")
        return [array("I", [t.id for t in self.tokenize(x)]).tobytes() for x in shown.split("\xff")]

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words (without the space before them). Letters and signs after them are two pieces,
        and most words share theirs with others; other Latin words are cut by a pattern, the rest goes through the library."""
        words = words.cast(pa.large_string())
        letters, signs = pc.ascii_rtrim(words, _SIGNS), pc.utf8_ltrim(words, _LETTERS)
        two = pc.and_(pc.and_(pc.greater(pc.binary_length(letters), 0), pc.string_is_ascii(signs)),
                      pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(signs)), pc.binary_length(words)))
        halves = [letters.filter(two).dictionary_encode(), signs.filter(two).dictionary_encode()]
        spaced = pc.binary_join_element_wise(_BLANK, words.filter(pc.invert(two)), _NOTHING)
        cut, far = [], np.zeros(len(spaced), dtype=bool)
        for i, word in enumerate(_strings(spaced)):
            if word.isascii() or not _FAR.search(word):
                cut.append(_PIECES.findall(word))
            else:
                far[i] = True
        heads, tails = len(halves[0].dictionary), len(halves[1].dictionary)
        ids = self.pieces.get(pa.concat_arrays([
            pc.binary_join_element_wise(_BLANK, halves[0].dictionary, _NOTHING), halves[1].dictionary,
            pa.array([piece for pieces in cut for piece in pieces], pa.large_string())]), self._ask)
        upto = np.cumsum([0, *map(len, cut)])
        others = self.words.get(spaced.filter(pa.array(far)), lambda new: self._library(_strings(new)))
        found = pa.concat_arrays([
            pc.binary_join_element_wise(ids.slice(0, heads).take(halves[0].indices),
                                        ids.slice(heads, tails).take(halves[1].indices), pa.scalar(b"", pa.large_binary())),
            pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), ids.slice(heads + tails)),
                           pa.scalar(b"", pa.large_binary())).cast(pa.large_binary()), others])
        two = two.to_numpy(zero_copy_only=False)
        at = np.cumsum(two) - 1
        at[~two] = int(two.sum()) + np.where(far, len(cut) + np.cumsum(far), np.cumsum(~far)) - 1
        return found.take(pa.array(at))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the last's end)."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        plain = np.zeros(len(texts), dtype=bool)
        if self.by_word:
            plain = ~pc.match_substring_regex(texts, _GAP).to_numpy(zero_copy_only=False)
        # each text is a run of parts: a head (or all of it) from the library, then its other words
        cut = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        words = cut.flatten()
        is_head = np.zeros(len(words), dtype=bool)
        is_head[offsets[:-1] - offsets[0]] = True
        coded = words.filter(pa.array(~is_head)).dictionary_encode()
        whole = pa.concat_arrays([words.filter(pa.array(is_head)), texts.filter(pa.array(~plain))])
        known = self._words(coded.dictionary)
        parts = pa.concat_arrays([known, pa.array(self._library(whole.to_pylist()), pa.large_binary())])

        n_parts = np.ones(len(texts), dtype=np.int64)
        n_parts[plain] = np.diff(offsets)
        first = np.cumsum(n_parts) - n_parts
        order = np.empty(int(n_parts.sum()), dtype=np.int64)
        tail = np.ones(len(order), dtype=bool)
        tail[first] = False
        order[first[plain]] = len(known) + np.arange(int(plain.sum()))
        order[first[~plain]] = len(known) + int(plain.sum()) + np.arange(int((~plain).sum()))
        order[tail] = coded.indices.to_numpy()
        picked = parts.take(pa.array(order))
        _, offsets, raw = picked.buffers()
        upto = np.frombuffer(offsets, dtype=np.int64)[:len(order) + 1] // 4
        return np.frombuffer(raw or b"", dtype="<u4", count=int(upto[-1])), upto[np.append(first, len(order))]


def write_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0,
                tasks: int | None = None) -> DataFrame:
    """Encode every text, add ``end_id``, and write section files into ``folder`` (a fresh one under the
    shared checkpoint folder by default). Returns the manifest ``(chunk, path, n_docs, n_ids, n_bytes)``,
    a written table. Chunks are ranges of ``doc_id`` of about equal counts, each read as a sorted stream; a
    task that runs again writes the same files again, under a temporary name first."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = id_text(docs)
    folder = qualified(spark, folder or work_dir(spark, "token-files"))
    if not 0 <= end_id <= 0xFFFF:
        raise ValueError(f"end id {end_id}: only 0 to 65535 can be coded")
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10000, 20 * n))).first()[0] if n > 1 else []
    edges = np.unique(np.array(cuts or [], dtype=np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column("doc_id")
            chunk = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0,
                             np.searchsorted(edges, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right"))
            yield pa.record_batch([pa.array(chunk, pa.int32()), ids, b.column("text")], ["chunk", "doc_id", "text"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = TextEncoder(tokenizer_path), np.array([end_id], dtype="<u4")
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        chunk, done, section, held_ids, held, size = None, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            raw = pack(held_ids, [len(x) + 1 for x in held], np.concatenate([y for x in held for y in (x, end)]), done)
            name = f"{base}/chunk-{chunk:06d}-{section:06d}.cmr"
            own = f"{base}/_{uuid.uuid4().hex}-{chunk:06d}-{section:06d}"
            with fs.open_output_stream(own) as f:
                f.write(raw)
            fs.move(own, name)
            return pa.RecordBatch.from_pylist([{"chunk": chunk, "path": f"{folder}/{name.rpartition('/')[2]}", "n_docs": len(held_ids),
                                                "n_ids": size, "n_bytes": len(raw)}], schema=_MANIFEST)
        for b in slices(batches, TEXT_BYTES):
            ids, upto = encoder.encode(b.column("text"))
            for c, i, x, y in zip(b.column("chunk").to_pylist(), b.column("doc_id").to_pylist(), upto[:-1].tolist(), upto[1:].tolist()):
                if held and (c != chunk or size >= SECTION):
                    yield flush()
                    done, section = done + size, section + 1
                    held_ids, held, size = [], [], 0
                if c != chunk:
                    chunk, done, section = c, 0, 0
                held_ids.append(i)
                held.append(ids[x:y])
                size += y - x + 1
        if held:
            yield flush()
    written = (rows.mapInArrow(deal, "chunk int, doc_id long, text string").repartitionById(len(edges) + 1, "chunk")
               .sortWithinPartitions("chunk", "doc_id", "text")
               .mapInArrow(write, "chunk int, path string, n_docs long, n_ids long, n_bytes long"))
    return save(written, "token-manifest")


_MANIFEST = pa.schema([("chunk", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, from the files alone. The ids before
    a chunk are sums over the chunks' totals, of which there are as many as writing tasks."""
    ship_package(manifest.sparkSession)
    totals = manifest.groupBy("chunk").agg(F.sum("n_ids").alias("n"))
    base = totals.select("chunk", (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("base"))
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, path in zip(b.column("base").to_pylist(), b.column("path").to_pylist()):
                fs, name = _fs(path)
                with fs.open_input_stream(name) as f:
                    doc_ids, lengths, ids, before = unpack(f.read())
                at = np.zeros(len(lengths) + 1, dtype=np.int64)
                np.cumsum(lengths, out=at[1:])
                flat = ids.astype("<u4")
                columns = [pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + before + base, pa.int64()),
                           pa.array(lengths.astype(np.int64), pa.int64()),
                           pa.array([zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])
    # a number of partitions is given, or the few short rows of the manifest would be joined into one task;
    # documents are read after the join, so only rows of the manifest are ever joined
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.join(base, "chunk").select("path", "base").repartition(n, "path").mapInArrow(read, kind)

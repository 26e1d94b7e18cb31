"""Byte-level BPE encoding and decoding.

Texts are cut into pieces without a regular expression. Each character gets a class (letter, number, space, other) from a table
over all code points and, from it, a transition function of a four-state machine; functions compose, and composition is
associative, so a blocked prefix scan over the function codes gives the state before every character at once. States and
classes mark where pieces begin. The pieces then go through a cache to pair merging by rank. Ids keep the byte offset of each token;
decoding writes the vocabulary's bytes to these offsets, and a stretch of the text is decoded from the tokens whose offsets it covers.

Defined cases: a null text counts as empty and gives no ids; repeated rows are encoded row by row; an empty table gives an empty
result; other columns are ignored; a text longer than ``CHUNK`` is taken in parts, cut before a blank behind a solid character, where a piece
always ends.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, open_fs, ship

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the White_Space property.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Bounds the memory of a worker: pieces in its cache, which starts afresh when full, and characters worked on at once.
CACHE, CHUNK = 1_000_000, 1 << 19

# States after a character: FREE; OPEN: a run of others, or a blank that the next run takes in; ONE, TWO: letters left of a contraction.
FREE, OPEN, ONE, TWO = range(4)


def _code(*to: int) -> int:
    """A function of the state as one byte: where each state goes, two bits each."""
    return sum(x << (2 * i) for i, x in enumerate(to))


IDENTITY = _code(FREE, OPEN, ONE, TWO)
WORD_STEP = _code(FREE, FREE, FREE, ONE)
OPEN_STEP = _code(OPEN, OPEN, OPEN, OPEN)
SHORT_STEP = _code(ONE, OPEN, ONE, ONE)
LONG_STEP = _code(TWO, OPEN, TWO, TWO)


@functools.cache
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = SPACE
    return table


@functools.cache
def compose_table() -> np.ndarray:
    """First f, then g, at index f * 256 + g."""
    f, g = np.divmod(np.arange(1 << 16, dtype=np.uint32), 256)
    return sum(((g >> (2 * ((f >> (2 * s)) & 3))) & 3) << (2 * s) for s in range(4)).astype(np.uint8)


def states_after(steps: np.ndarray, block: int = 64) -> np.ndarray:
    """The state after each step from FREE, by a prefix scan of compositions: within blocks side by side, then over block totals."""
    n = len(steps)
    if n <= block:
        out, s = np.empty(n, np.uint8), FREE
        for i, f in enumerate(steps.tolist()):
            s = (f >> (2 * s)) & 3
            out[i] = s
        return out
    rows = -(-n // block)
    padded = np.full(rows * block, IDENTITY, np.uint8)
    padded[:n] = steps
    scan = np.ascontiguousarray(padded.reshape(rows, block).T)
    table = compose_table()
    for k in range(1, block):
        scan[k] = table[(scan[k - 1].astype(np.uint16) << 8) | scan[k]]
    before = np.empty(rows, np.uint8)
    before[0] = FREE
    before[1:] = states_after(scan[-1], block)[:-1]
    return ((scan >> (before << 1)) & 3).T.reshape(-1)[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin, among the code points of texts laid end to end that begin at ``firsts`` (no empty texts)."""
    n = len(points)
    cls = class_table()[points]
    is_first = np.zeros(n, bool)
    is_first[firsts] = True
    is_last = np.zeros(n, bool)
    is_last[firsts[1:] - 1] = True
    is_last[-1:] = True
    nxt = np.zeros(n, points.dtype)
    nxt[:-1] = points[1:]
    nxt[is_last] = 0
    blank = points == 0x20
    steps = np.full(n, WORD_STEP, np.uint8)
    steps[(cls == OTHER) | blank] = OPEN_STEP
    at = np.flatnonzero((points == 0x27) & ~is_last)
    if len(at):
        one = nxt[at]
        two = np.where(is_last[at + 1], 0, nxt[np.minimum(at + 1, n - 1)])
        is_ = lambda c, x: x == ord(c)
        steps[at[is_("s", one) | is_("t", one) | is_("m", one) | is_("d", one)]] = SHORT_STEP
        steps[at[(is_("e", two) & (is_("r", one) | is_("v", one))) | (is_("l", one) & is_("l", two))]] = LONG_STEP
    apostrophe = (steps == SHORT_STEP) | (steps == LONG_STEP)
    f = steps[firsts]  # a text's first character starts from FREE, whatever came before
    steps[firsts] = (f & 3) * 0b01010101
    after = states_after(steps)
    before = np.empty(n, np.uint8)
    before[1:] = after[:-1]
    before[firsts] = FREE
    prev_cls = np.empty(n, np.uint8)
    prev_cls[1:] = cls[:-1]
    prev_cls[:1] = OTHER
    prev_blank = np.zeros(n, bool)
    prev_blank[1:] = blank[:-1]
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = cls[1:] != SPACE
    next_solid &= ~is_last
    space = cls == SPACE
    start = np.where(space, (prev_cls != SPACE) | next_solid, (cls != prev_cls) & ~prev_blank)
    start &= before < ONE
    start |= apostrophe & (before == FREE)
    ended = np.zeros(n, bool)
    ended[1:] = before[:-1] == ONE
    return start | ended | is_first


@functools.cache
def _power_tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    up = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full((1 << 16) - 1, b, np.uint64))])
    return up(base), up(pow(base, 1 << 16, 1 << 64))


def power_at(base: int, at: np.ndarray) -> np.ndarray:
    """``base`` to the power of each number (below 2^32), modulo 2^64, from two tables of 2^16 entries."""
    low, high = _power_tables(base)
    return low[at & 0xFFFF] * high[at >> 16]


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0..n-1; made for the call, so that nothing as long as a text is kept."""
    low, high = _power_tables(base)
    return (high[: -(-n >> 16), None] * low).reshape(-1)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def piece_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes of each piece from ``begin`` to ``end``."""
    hashes = []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(0x632BE5AB)) * powers(base, len(points)), out=total[1:])
        hashes.append((total[end] - total[begin]) * power_at(inverse(base), begin))
    return hashes[0], hashes[1]


def portions(texts: list[str], most: int = CHUNK):
    """Lists of (text number, part) of about ``most`` characters; a longer text is cut before a blank behind a solid character."""
    held, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = min(at + most, len(t))
            while end < len(t):
                end = t.find(" ", end)
                if end < 0 or not t[end - 1].isspace():
                    break
                end += 1
            end = len(t) if end < 0 else end
            if size and size + end - at > most:
                yield held
                held, size = [], 0
            held.append((i, t[at:end]))
            size += end - at
            at = end
            if at >= len(t):
                break
    if held:
        yield held


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin, begin + 1, ... of each span, end to end."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class PairMerger:
    """Merges the symbols of many pieces side by side: in each step every piece merges its lowest-ranked pair, the leftmost among equals.

    Pairs are looked up in an open-addressing table held in arrays. Pieces without a pair left drop out, so a step costs what the
    unfinished ones hold; very long pieces go one at a time through a heap instead, in n log n steps.
    """

    NONE = np.iinfo(np.int64).max
    LONG = 96

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, self.NONE)
        self.merged = np.zeros(1 << self.bits, np.int64)
        todo, slots = np.arange(len(keys)), self._slots(keys)
        rank, merged = np.asarray(rank, np.int64), np.asarray(merged, np.int64)
        while len(todo):
            free = np.flatnonzero(self.keys[slots] == np.uint64(2**64 - 1))
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.ranks[slots[won]], self.merged[slots[won]] = keys[todo[won]], rank[todo[won]], merged[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slots = todo[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """(rank or NONE, merged symbol) of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slots(keys)
        seen = self.keys[slots]
        at = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(at):
            slots[at] = (slots[at] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[at]]
            at = at[(seen != keys[at]) & (seen != np.uint64(2**64 - 1))]
        return self.ranks[slots], self.merged[slots]

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Initial symbols of pieces laid end to end (none empty) -> their ids end to end, and how many each has."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        got_owner, got = [], []
        long = np.flatnonzero(sizes > self.LONG)
        if len(long):
            begin = np.cumsum(sizes) - sizes
            for i in long.tolist():
                got.append(self._one(symbols[begin[i] : begin[i] + sizes[i]]))
                got_owner.append(np.full(len(got[-1]), i))
            keep = np.repeat(sizes <= self.LONG, sizes)
            symbols, owner = symbols[keep], owner[keep]
        rank, merged = np.full(len(symbols), self.NONE), np.zeros(len(symbols), np.int64)
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        rank[joined], merged[joined] = self.find(symbols[joined], symbols[joined + 1])
        symbols = symbols.astype(np.int64)
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbols)))
            done = best == self.NONE
            if done.any():
                keep = np.repeat(~done, size)
                got.append(symbols[~keep])
                got_owner.append(owner[~keep])
                symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
                best, size = best[~done], size[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            own = owner[at]
            at = at[np.concatenate([[True], own[1:] != own[:-1]])]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
            rank[moved] = self.NONE
            near = np.concatenate([moved, moved[moved > 0] - 1])
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            rank[near], merged[near] = self.find(symbols[near], symbols[near + 1])
        if not got:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        owner = np.concatenate(got_owner)
        return np.concatenate(got)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def _one(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        sym, after, before, alive = symbols.astype(np.int64).tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank, merged = self.find(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
        heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist(), strict=True)) if r != self.NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = m, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (i, before[i]):
                if x >= 0 and after[x] < n:
                    r, y = self.find(np.array([sym[x]]), np.array([sym[after[x]]]))
                    if r[0] != self.NONE:
                        heapq.heappush(heap, (int(r[0]), x, sym[x], sym[after[x]], int(y[0])))
        return np.array([s for s, ok in zip(sym, alive, strict=True) if ok], np.int64)


class PieceCache:
    """Ids by piece, held in arrays sorted by the piece's first hash; the second hash guards the first.

    At most ``CACHE`` pieces are held; when full it starts afresh. ``whole`` names pieces that are one id whatever the merges say.
    """

    def __init__(self, merger: PairMerger, initial: np.ndarray, whole: dict[bytes, int] | None = None):
        self.merger, self.initial, self.whole = merger, initial, whole
        self.forget()

    def forget(self) -> None:
        self.key, self.guard = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _merged(self, text: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for the pieces from ``begin`` to ``end``."""
        raw = text.encode()
        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        begin, size = at[begin], at[end] - at[begin]
        symbols = self.initial[np.frombuffer(raw, np.uint8)[spans(begin, size)]]
        if self.whole:
            one = np.array([self.whole.get(raw[i : i + n], -1) for i, n in zip(begin.tolist(), size.tolist(), strict=True)], np.int64)
            first = np.cumsum(size) - size
            keep = np.repeat(one < 0, size)
            keep[first[one >= 0]] = True
            symbols[first[one >= 0]] = one[one >= 0]
            symbols, size = symbols[keep], np.where(one < 0, size, 1)
        return self.merger.merge(symbols, size)

    def pieces(self, points: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end."""
        begin = np.flatnonzero(boundaries(points, firsts))
        return begin, np.append(begin[1:], len(points))

    def look_up(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) in ``self.ids`` for each piece from ``starts`` to ``ends``."""
        if len(self.key) > CACHE:
            self.forget()
        key, guard = piece_hashes(points, starts, ends)
        key, first, same = np.unique(key, return_index=True, return_inverse=True)
        if (guard != guard[first][same]).any():  # two kinds of piece share a hash: each piece for itself, and nothing is kept
            ids, size = self._merged(text, points, starts, ends)
            self.forget()
            self.ids = ids.astype(np.uint32)
            return np.cumsum(size) - size, size
        guard = guard[first]
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        hit = (self.key[at] == key) & (self.guard[at] == guard) if len(self.key) else np.zeros(len(key), bool)
        new = np.flatnonzero(~hit)
        begin, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        begin[hit], size[hit] = self.begin[at[hit]], self.size[at[hit]]
        if len(new):
            ids, size[new] = self._merged(text, points, starts[first[new]], ends[first[new]])
            begin[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            fresh = new[self.key[at[new]] != key[new]] if len(self.key) else new
            to = np.searchsorted(self.key, key[fresh])  # both ascend, so the cache stays in order without a sort
            self.key, self.guard = np.insert(self.key, to, key[fresh]), np.insert(self.guard, to, guard[fresh])
            self.begin, self.size = np.insert(self.begin, to, begin[fresh]), np.insert(self.size, to, size[fresh])
        return begin[same], size[same]

    def coded(self, texts: list[str]):
        """For each portion: the text numbers of its parts, all ids end to end, and where each part's ids begin and end."""
        for part in portions(texts):
            numbers, lengths = [i for i, _ in part], np.array([len(t) for _, t in part], np.int64)
            if not lengths.sum():
                yield numbers, np.zeros(0, np.uint32), np.zeros((len(part), 2), np.int64)
                continue
            text = "".join(t for _, t in part)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            begins = np.cumsum(lengths) - lengths
            cuts, ends = self.pieces(points, begins[lengths > 0])
            begin, size = self.look_up(text, points, cuts, ends)
            to = np.concatenate([[0], np.cumsum(size)])
            yield numbers, self.ids[spans(begin, size)], np.stack([to[np.searchsorted(cuts, begins)], to[np.searchsorted(cuts, begins + lengths)]], 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for numbers, ids, edges in self.coded(texts):
            flat = ids.astype("<u4")
            for i, (a, b) in zip(numbers, edges.tolist(), strict=True):
                out[i].append(flat[a:b].tobytes())
        return [b"".join(x) for x in out]


class Codec(PieceCache):
    """Ranks of a vocabulary file; encodes and decodes. Made once in each Python worker."""

    def __init__(self, path: str):
        files, at = open_fs(path)
        with files.open_input_stream(at) as f:
            lines = f.read().split(b"\n")
        ranks = {base64.b64decode(x[0]): int(x[1]) for x in map(bytes.split, lines) if x}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.widths = np.array([len(x) for x in tokens], np.int64)
        self.letters, self.places = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.widths) - self.widths
        pairs = [(a, b, i) for token, i in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        super().__init__(PairMerger(left, right, merged, merged), np.array([ranks[bytes([b])] for b in range(256)]), ranks)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins."""
        return np.cumsum(self.widths[ids]) - self.widths[ids]

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """Each token's bytes at its offset; the first token's offset is the start. Without offsets tokens follow each other."""
        if not len(ids):
            return b""
        offsets = self.offsets(ids) if offsets is None else offsets
        size = self.widths[ids]
        out = np.empty(int(offsets[-1] - offsets[0] + size[-1]), np.uint8)
        out[spans(offsets - offsets[0], size)] = self.letters[spans(self.places[ids], size)]
        return out.tobytes()

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray, first: int, end: int) -> bytes:
        """Bytes ``first`` to ``end`` of the text, from the tokens that cover them alone."""
        if first >= end or not len(ids):
            return b""
        a, b = max(int(np.searchsorted(offsets, first, "right")) - 1, 0), int(np.searchsorted(offsets, end))
        return self.decode(ids[a:b], offsets[a:b])[first - int(offsets[a]) :][: end - first]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), offsets (array of long: the byte of the text at which each token begins)."""
    ship(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in c.encode([t or "" for t in batch["text"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.offsets(x) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return _rows(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, offsets -> doc_id, bytes. Null ids count as none."""
    ship(encoded.sparkSession)

    def run(batches):
        c = codec(path)
        for batch in batches:
            both = zip(batch["ids"].to_pylist(), batch["offsets"].to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([c.decode(np.array(x or [], np.int64), np.array(at or [], np.int64)) for x, at in both], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(lean(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, and decode its ids by their offsets, in the same task: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]

    def run(batches):
        c = codec(path)
        for batch in batches:
            n, size = np.zeros((2, batch.num_rows), np.int64)
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in range(batch.num_rows)]
            for numbers, ids, edges in c.coded([t or "" for t in batch["text"].to_pylist()]):
                at = c.offsets(ids)
                raw, flat, ends = c.decode(ids, at), ids.astype("<u4"), np.append(at, at[-1] + c.widths[ids[-1]] if len(at) else 0)
                for i, (a, b) in zip(numbers, edges.tolist(), strict=True):
                    sums[i][0].update(flat[a:b].tobytes())
                    sums[i][1].update(raw[ends[a] : ends[b]])
                    n[i] += b - a
                    size[i] += ends[b] - ends[a]
            columns = [pa.array([x[k].hexdigest() for x in sums], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), *columns, pa.array(size)], names)

    return _rows(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")

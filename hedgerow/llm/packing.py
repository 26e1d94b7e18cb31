"""Best-fit packing of token sequences by swap-based local search.

Items of one length are interchangeable, so the search runs on the histogram of lengths (at most ``size`` numbers, whatever
the corpus) and on groups of bins with the same contents. Best fit in decreasing order makes a first packing; then bins below
capacity trade: an item moves, one is exchanged for one, or two for one, whenever the sum of squared fills rises, which empties
the least filled bins. Bins are indexed by what they can give, so all trades of a bin are looked up at once, and the search ends only when no
trade is left or fewer bins are impossible. The plan that results says, for each length, which ranks go to which bins; rows get their rank from
prefix sums over task counts, which a merge join brings to them, so no task sees more than its own rows and nothing that grows with the tasks is broadcast.

Defined cases: a null text counts as empty (one item with the end id alone); only documents longer than ``size`` are cut, the
first piece being the shorter; repeated rows are packed each for itself; an empty table gives an empty result; other
columns are ignored by ``pack_documents``.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PairMerger, PieceCache
from .common import lean, open_fs, ship, staged


class PieceEncoder(PieceCache):
    """A byte-level BPE of the tokenizers library's file format: its merges in order, its ids. Equal to the library's ids (tested).

    Added tokens that a text holds are cut out first, as the library does; what lies between them is encoded as texts of their own.
    """

    def __init__(self, path: str):
        files, at = open_fs(path)
        with files.open_input_stream(at) as f:
            spec = json.loads(f.read())
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"] if t["content"]}
        if spec["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.marker = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = ([vocab[m[k]] for m in merges] for k in (0, 1))
        merged = [vocab[a + b] for a, b in merges]
        super().__init__(PairMerger(left, right, range(len(merges)), merged), np.array([vocab[c] for c in byte_letters()]))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.marker.split(t) if self.marker else [t] for t in texts]  # between two markers' texts stands a marker
        plain = iter(super().encode([x for parts in cut for x in parts[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(plain) for k, x in enumerate(parts)) for parts in cut]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def best_fit(lengths: dict[int, int], size: int) -> Counter:
    """Groups of bins (contents in descending order -> number of bins) by best fit in decreasing order."""
    room: dict[int, Counter] = defaultdict(Counter)
    for s in sorted(lengths, reverse=True):
        left = lengths[s]
        while left:
            r = next((r for r in range(s, size) if room[r]), None)
            if r is None:
                each = min(left, size // s)
                bins = left // each
                room[size - each * s][(s,) * each] += bins
                left -= bins * each
                continue
            contents, bins = next(iter(room[r].items()))
            each = min(left, r // s)
            bins = min(bins, left // each)
            room[r][contents] -= bins
            if not room[r][contents]:
                del room[r][contents]
            room[r - each * s][contents + (s,) * each] += bins
            left -= bins * each
    return Counter({c: n for by in room.values() for c, n in by.items() if n})


class Givers:
    """Groups of bins by the sum of ``items`` (1 or 2) of their items; ``fill[s]`` is the least fill of those that can give ``s``."""

    def __init__(self, size: int, items: int):
        self.none, self.items = size + 1, items
        self.at: dict[int, dict[int, dict[tuple, None]]] = defaultdict(dict)
        self.fill = np.full(3 * size + 2, self.none, np.int64)  # a base of up to twice the size, and the room above it

    def sums(self, contents: tuple) -> list[int]:
        return list(dict.fromkeys(sum(x) for x in combinations(contents, self.items))) if len(contents) < 50 else self._many(contents)

    def _many(self, contents: tuple) -> list[int]:
        kinds = Counter(contents)
        return list(dict.fromkeys(sum(x) for x in combinations_with_replacement(kinds, self.items) if len(set(x)) == self.items or kinds[x[0]] >= self.items))

    def add(self, contents: tuple, fill: int) -> None:
        for s in self.sums(contents):
            self.at[s].setdefault(fill, {})[contents] = None
            self.fill[s] = min(self.fill[s], fill)

    def remove(self, contents: tuple, fill: int) -> None:
        for s in self.sums(contents):
            by = self.at[s]
            del by[fill][contents]
            if not by[fill]:
                del by[fill]
                if self.fill[s] == fill:
                    self.fill[s] = min(by, default=self.none)

    def first(self, s: int) -> tuple:
        return next(iter(self.at[s][int(self.fill[s])]))


def _parts(contents: tuple, total: int, items: int) -> tuple:
    """``items`` of the contents whose sum is ``total``."""
    kinds = Counter(contents)
    if items < 2:
        return (total,) * items
    return next((v, total - v) for v in kinds if kinds[total - v] > (total - v == v))


def local_search(bins: Counter, size: int) -> Counter:
    """Trade between underfull bins until no trade raises the sum of squared fills, or fewer bins are impossible.

    A bin takes more than it gives back from one that is no fuller: one item for none, one or two, or two items for one. Any such trade
    raises the sum; each bin makes the one that raises it most, the fullest bins first.
    """
    bins = Counter({c: n for c, n in bins.items() if n and c})
    least, count = -(-sum(sum(c) * n for c, n in bins.items()) // size), sum(bins.values())
    one, two = Givers(size, 1), Givers(size, 2)

    def put(contents: tuple, n: int) -> None:
        fill = sum(contents)
        if not contents or not n:
            return
        was, bins[contents] = bins[contents], bins[contents] + n
        change = "add" if not was else "remove" if not bins[contents] else None
        if not bins[contents]:
            del bins[contents]
        if change and fill < size:
            getattr(one, change)(contents, fill)
            getattr(two, change)(contents, fill)

    def best(taker: tuple):
        """(giver, items out, items back) of the taker's best trade."""
        fill = sum(taker)
        room = np.arange(1, size - fill + 1)
        back = [(0, 0), *((r, 1) for r in one.sums(taker)), *((r, 2) for r in two.sums(taker))]
        tries = [(one, back), (two, back[1 : 1 + len(one.sums(taker))])]
        found = (0,)
        for givers, bases in tries:
            if not bases:
                continue
            fills = givers.fill[np.array([r for r, _ in bases])[:, None] + room]
            gain = np.where(fills <= fill, room * (room + fill - fills), 0)
            k = int(gain.argmax())
            if gain.flat[k] > found[0]:
                found = int(gain.flat[k]), givers, *bases[k // len(room)], k % len(room) + 1
        if not found[0]:
            return None
        _, givers, r, items, d = found
        giver = givers.first(r + d)
        return giver, _parts(giver, r + d, givers.items), _parts(taker, r, items)

    swap = lambda bin_, less, more: tuple(sorted((Counter(bin_) - Counter(less) + Counter(more)).elements(), reverse=True))
    for c, n in list(bins.items()):
        del bins[c]
        put(c, n)
    traded = True
    while traded and count > least:
        traded = False
        todo = [(-sum(c), c) for c in bins if sum(c) < size]
        heapq.heapify(todo)
        while todo and count > least:
            taker = heapq.heappop(todo)[1]
            n = bins.get(taker, 0)
            if not n:
                continue
            if n == 1:  # it can't give to itself
                put(taker, -1)
            trade = best(taker)
            if n == 1:
                put(taker, 1)
            if not trade:
                continue
            giver, out, given = trade
            times = n // 2 if giver == taker else min(bins[giver], n)
            put(giver, -times)
            put(taker, -times)
            for c in (swap(giver, out, given), swap(taker, given, out)):
                put(c, times)
                count -= 0 if c else times
                if c and sum(c) < size:
                    heapq.heappush(todo, (-sum(c), c))
            if bins.get(taker, 0):
                heapq.heappush(todo, (-sum(taker), taker))
            traded = True
    return bins


def plan(lengths: dict[int, int], size: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset in it), by ascending first rank."""
    out, used, sequence = defaultdict(list), Counter(), 0
    for contents, n in sorted(local_search(best_fit(lengths, size), size).items()):
        offset = 0
        for s in contents:
            out[s].append((used[s], sequence, offset))
            used[s] += n
            offset += s
        sequence += n
    return {s: np.array(v, np.int64) for s, v in out.items()}


def pack(items: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to staged rows that have ``length``, ``task`` and ``local`` (the row's number among those of
    its task and length)."""
    counts = staged(items.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = plan(lengths, size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = items.join(bases.hint("merge"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "task", "local")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        for batch in batches:
            length, rank = (batch[k].to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length).tolist():
                at, rows = np.flatnonzero(length == s), table[s]
                found = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = found[:, 1] + rank[at] - found[:, 0], found[:, 2]
            names = [f.name for f in schema[:-2]]
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place, 1 << 14), schema)


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents cut into pieces, staged: doc_id, piece, start, length, ids_crc32, task, local."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "local")

    def cut(batches):
        from pyspark import TaskContext

        encoder, task, seen = piece_encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["doc_id"].to_pylist(), encoder.encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                raw += end
                n = len(raw) // 4
                stop = n % size or size
                begin = piece = 0
                while begin < n:
                    length = stop - begin
                    rows.append((doc, piece, begin, length, zlib.crc32(raw[4 * begin : 4 * stop]), task, seen[length]))
                    seen[length] += 1
                    begin, stop, piece = stop, stop + size, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "piece" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return staged(rows.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, task long, local long"), "pieces")


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    out = pack(pieces_of(docs, path, size, end_id, id_col, text_col), size)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

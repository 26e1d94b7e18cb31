"""Substring dedup: merged Burrows-Wheeler transforms of shards.

Removes each byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller id.

1. Texts are bytes. Each window of ``LENGTH`` bytes has a minimizer, the least hash among its ``GRAM``-byte grams, so equal windows have equal
   minimizers wherever they stand. One packed exchange (about ten bytes for each minimizer, about one for every sixteen bytes of text; texts are told
   apart by all 128 bits of their digest) finds those that occur in two different texts; a text whose minimizers are all its own takes no further part.
   Minimizers that are hot, by their count in a bounded sample of texts, are taken as shared without the exchange, where each would gather in one place.
2. Runs of windows with one shared minimizer become strings of at most 80 bytes, dealt out by minimizer: equal windows meet in
   one bucket. A bucket's size is set by the corpus size, not by the number of executors.
3. A bucket is marked in blocks of about 1 MB, dealt by minimizer as well, so that a worker's memory hangs on the block. In a block, strings are cut into
   shards; each shard has its Burrows-Wheeler transform and last-to-first map. The transforms are merged by
   refining their interleaving: in step k every row steps back by two symbols, stably, after which rows are in order of
   their first 2k bytes and an interval boundary stands where the common prefix is shorter than 2k. Rows begin where a window ends, and drop out when alone in
   their interval. After
   ``LENGTH`` / 2 steps the intervals left are the repeated strings, without any sort of all suffixes; each knows its smallest document.
   The strings of hot minimizers are not put into buckets: equal ones become one kind by a partial aggregate, and only kinds are cut into windows. The smallest
   document of each window is a partial aggregate again, looked up for each string or, if there are many, brought back by ``spread_join``, first to the
   kinds, then to their strings.
4. What is to go returns to its document as spans, and each text is cut once.

Of equal texts only one takes part; the others, if long enough, go wholly. The sample steers the work alone: whatever it holds, results are the same.

Defined cases: a null text counts as empty; texts under ``LENGTH`` bytes stay whole; a null id counts as larger than any other; rows with
the same id do not remove each other's bytes; an empty table gives an empty result; ``label`` ignores other columns, ``cut`` keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import inverse, powers, spans
from .common import lean, ship, spread_join, staged
from .shingles import mixed

LENGTH, GRAM = 50, 20
GRAMS = LENGTH - GRAM + 1
#: Bytes of text for each bucket, of a segment worked on at once, and of a shard; bytes of strings for each block of a bucket.
BUCKET_BYTES, SEGMENT, SHARD, BLOCK = 8 << 20, 1 << 20, 1 << 16, 1 << 20
NO_ID = np.iinfo(np.int64).max
#: Texts looked at for hot minimizers; the least number of them, and of all texts as it scales, that makes a minimizer hot.
SAMPLE_TEXTS, HOT_SAMPLED, HOT_TEXTS = 1 << 14, 8, 4096
#: Windows of hot minimizers that are sent to every task at most: 58 bytes each, 15 MB.
LOOKUP = 1 << 18
#: Windows of strings of hot minimizers written out at once: their places take some 1,200 bytes each.
WINDOWS = 1 << 14
#: Stands for all hot minimizers of a text.
_MARK = np.uint64((1 << 48) - 1)


def segments(texts: list[bytes]):
    """Lists of (text number, offset, bytes) of about ``SEGMENT`` bytes; parts of one text overlap by a window less one byte."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            part = t[at : at + SEGMENT + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size and size + len(part) > SEGMENT:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def window_runs(parts: list[tuple[int, int, bytes]]):
    """Runs of windows with one minimizer: (part number, first and last window's place in the joined bytes, minimizer)."""
    raw = b"".join(p for _, _, p in parts)
    data = np.frombuffer(raw, np.uint8)
    base = 0xC2B2AE3D27D4EB4F
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(0x27D4EB2F)) * powers(base, len(data)), out=total[1:])
    gram = mixed((total[GRAM:] - total[:-GRAM]) * powers(inverse(base), len(total) - GRAM))
    place = np.uint64(0xFFFFFF) - np.arange(len(gram), dtype=np.uint64)
    least = (gram & np.uint64(0xFFFFFFFFFF000000)) | place  # of equal grams, the last
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = GRAMS - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    sizes = np.array([len(p) for _, _, p in parts])
    owner = np.repeat(np.arange(len(parts)), sizes)
    good = owner[: len(least)] == owner[LENGTH - 1 :]
    at = np.flatnonzero(good)
    where = (np.uint64(0xFFFFFF) - (least[at] & np.uint64(0xFFFFFF))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return raw, owner[at[first]], at[first], at[last], gram[where[first]] >> np.uint64(16)


def _dealt(bucket: np.ndarray, n: int):
    """(bucket, its rows) for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(b, order[edge[b] : edge[b + 1]]) for b in np.flatnonzero(np.diff(edge)).tolist()]


def _packed(keys: np.ndarray, values: np.ndarray, n: int):
    """Values by key (64-bit numbers or 16 bytes), packed by a hash of the key into rows (bucket, keys, vals)."""
    spread = keys.view("<u8").reshape(len(keys), -1)[:, 0] if len(keys) else np.zeros(0, np.uint64)
    q = (mixed(spread.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    rows = [(b, keys[i].tobytes(), values[i].tobytes()) for b, i in _dealt(q, n)]
    b, k, v = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int64()), "keys": pa.array(k, pa.binary()), "vals": pa.array(v, pa.binary())})


def _by_key(packed: DataFrame, width: int, digests: bool) -> DataFrame:
    """Unpack rows of ``_packed``: one row for each key with all its values."""

    def gather(group):
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), "<u8").reshape(-1, 2 if digests else 1)
        vals = np.frombuffer(b"".join(group["vals"].to_pylist()), f"V{width}")
        order = np.lexsort(keys.T[::-1])
        keys, raw = keys[order], vals[order].tobytes()
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        edge = np.append(first, len(keys)).tolist()
        own = pa.array([k.tobytes() for k in keys[first]], pa.binary()) if digests else pa.array(keys[first, 0].astype(np.int64))
        return pa.table({"key": own, "vals": pa.array([raw[width * a : width * b] for a, b in zip(edge, edge[1:], strict=False)], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(gather, f"key {'binary' if digests else 'long'}, vals binary")


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _hot_minimizers(sample: DataFrame, least: float) -> np.ndarray:
    """Minimizers, in order, that stand in ``least`` of the sample's texts or more."""

    def count(batches):
        for batch in batches:
            for parts in segments([(t or "").encode() for t in batch["text"].to_pylist()]):
                _, part, _, _, h = window_runs(parts)
                text = np.array([i for i, _, _ in parts])[part].astype(np.uint64)
                h, n = np.unique(np.unique(h << np.uint64(16) | text) >> np.uint64(16), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    found = sample.select("text").mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["h"] for r in found.collect()], np.uint64))  # the sample's minimizers over HOT_SAMPLED at most, whatever the corpus


def _shared_minimizers(rows: DataFrame, n: int, hot) -> DataFrame:
    """key (digest of a text), vals: its minimizers that another text has too; ``_MARK`` among them stands for hot ones."""

    def find(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            digests = np.frombuffer(b"".join(batch["digest"].to_pylist()), "<u8").reshape(-1, 2)
            for parts in segments(texts):
                _, part, _, _, h = window_runs(parts)
                text = np.array([i for i, _, _ in parts])[part]
                is_hot = _is_in(h, hot.value)
                marked = np.unique(text[is_hot])
                h, text = np.append(h[~is_hot], np.full(len(marked), _MARK)), np.append(text[~is_hot], marked)
                deal = np.where(h == _MARK, digests[text, 0], h) % np.uint64(n)
                for b, i in _dealt(deal.astype(np.int64), n):
                    own, at = np.unique(text[i], return_inverse=True)
                    entries = np.unique(h[i] << np.uint64(16) | at.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([entries.tobytes()], pa.binary()), pa.array([digests[own].tobytes()], pa.binary())], ["bucket", "entries", "texts"])

    def reply(group):
        entries = [np.frombuffer(x, "<u8") for x in group["entries"].to_pylist()]
        texts = [np.frombuffer(x, "V16") for x in group["texts"].to_pylist()]
        base = np.cumsum([0, *map(len, texts)])
        every, same = np.unique(np.concatenate(texts), return_inverse=True)
        h = np.concatenate(entries) >> np.uint64(16)
        t = same[np.concatenate([(e & np.uint64(0xFFFF)).astype(np.int64) + a for e, a in zip(entries, base, strict=False)])]
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(begin, len(h)))
        two = np.repeat(t[begin] != t[begin + size - 1], size) | (h == _MARK)
        return _packed(every[t[two]], h[two], n)

    packed = rows.select("text", "digest").mapInArrow(lean(_joined(find)), "bucket long, entries binary, texts binary").groupBy("bucket").applyInArrow(reply, "bucket long, keys binary, vals binary")
    return _by_key(packed, 8, True)


def _joined(make):
    """Rows of one batch as one batch again: fewer, larger Arrow batches."""

    def run(batches):
        held = []
        for b in make(batches):
            held.append(b)
            if len(held) >= 512:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def _hits(batch, hot: np.ndarray):
    """For each segment of a batch of candidates, its runs of windows with a shared minimizer: bytes, first places, sizes, minimizers, whether hot, rows, ids, offsets."""
    texts = [(t or "").encode() for t in batch["text"].to_pylist()]
    rows = batch["row"].to_numpy()
    ids = batch["doc_id"].fill_null(int(NO_ID)).to_numpy()
    lists = [np.frombuffer(x, "<u8") for x in batch["vals"].to_pylist()]
    for parts in segments(texts):
        raw, part, first, last, h = window_runs(parts)
        doc, offset = (np.array([p[k] for p in parts]) for k in (0, 1))
        begin = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
        is_hot = _is_in(h, hot)
        wanted = np.concatenate([mixed(lists[i] ^ np.uint64(int(i) << 48)) for i in np.unique(doc)])
        hit = np.flatnonzero(np.isin(mixed(h ^ (doc[part].astype(np.uint64) << np.uint64(48))), wanted) | is_hot)
        part, first, last, h, is_hot = part[hit], first[hit], last[hit], h[hit], is_hot[hit]
        yield np.frombuffer(raw, np.uint8), first, last - first + LENGTH, h, is_hot, rows[doc[part]], ids[doc[part]], offset[part] + first - begin[part]


def _strings(candidates: DataFrame, n: int, hot) -> DataFrame:
    """Runs of windows with a shared minimizer, packed by minimizer; those of hot ones have a bucket ``n`` in name, which no task gathers."""

    def cut(batches):
        for batch in batches:
            for data, first, size, h, is_hot, rows, ids, starts in _hits(batch, hot.value):
                part = (h // np.uint64(n)).astype(np.uint8)
                for b, i in _dealt(np.where(is_hot, n, (h % np.uint64(n)).astype(np.int64)), n + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (data[spans(first[i], size[i])], size[i].astype(np.uint8), rows[i].astype("<i8"), ids[i].astype("<i8"), starts[i].astype("<i8"), part[i])]],
                        ["bucket", "data", "sizes", "rows", "ids", "starts", "parts"],
                    )

    return candidates.mapInArrow(lean(_joined(cut)), "bucket long, data binary, sizes binary, rows binary, ids binary, starts binary, parts binary")


def _unpacked(batch, *more: str):
    """Packed strings in pieces of about ``BLOCK`` bytes: bytes, sizes, rows, ids, starts, and what else is named."""
    for packed in zip(*[batch[k].to_pylist() for k in ("data", "sizes", "rows", "ids", "starts", *more)], strict=True):
        data, size, *columns = (np.frombuffer(x, t) for x, t in zip(packed, (np.uint8, np.uint8, *["<i8"] * (3 + len(more))), strict=True))
        size = size.astype(np.int64)
        end = np.cumsum(size)
        edge = np.unique(np.searchsorted(end, np.arange(0, len(data), BLOCK), side="right")).tolist()
        for a, b in zip(edge, [*edge[1:], len(size)], strict=True):
            yield data[end[a] - size[a] : end[b - 1]], size[a:b], *[x[a:b] for x in columns]


def _cut_windows(data: np.ndarray, size: np.ndarray):
    """The windows of strings laid end to end, ``WINDOWS`` at once: numbers of their strings, places in them, bytes."""
    windows = size - LENGTH + 1
    at = np.repeat(np.arange(len(size)), windows)
    step = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.cumsum(size) - size
    for k in range(0, len(at), WINDOWS):
        i, go = at[k : k + WINDOWS], step[k : k + WINDOWS]
        yield i, go, data[spans(begin[i] + go, np.full(len(i), LENGTH))]


def _hot_windows(strings: DataFrame, *more: str) -> DataFrame:
    """Each window of packed strings: window (its bytes), row, id, start, and what else is named."""

    def cut(batches):
        for batch in batches:
            for data, size, rows, ids, starts, *others in _unpacked(batch, *more):
                for i, go, flat in _cut_windows(data, size):
                    own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(i), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([own, pa.array(rows[i]), pa.array(ids[i]), pa.array(starts[i] + go), *[pa.array(x[i]) for x in others]], ["window", "row", "id", "start", *more])

    return strings.mapInArrow(lean(cut), ", ".join(["window binary, row long, id long, start long", *[f"{x} long" for x in more]]))


def _binaries(data: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _hot_kinds(strings: DataFrame) -> DataFrame:
    """The different ones of packed strings, packed again, staged: rows numbers them, ids and most are their smallest and largest documents, n counts them."""

    def combine(batches):
        for batch in batches:
            for data, size, _, ids, _ in _unpacked(batch):
                first, kind = _alike(data, size)
                begin = np.cumsum(size) - size
                least, most = np.full(len(first), NO_ID), np.full(len(first), np.iinfo(np.int64).min)
                np.minimum.at(least, kind, ids)
                np.maximum.at(most, kind, ids)
                own = _binaries(data[spans(begin[first], size[first])], size[first])
                yield pa.RecordBatch.from_arrays([own, pa.array(least), pa.array(most), pa.array(np.bincount(kind))], ["string", "least", "most", "n"])

    def pack(batches):
        for batch in batches:
            own = batch["string"].to_pylist()
            columns = [batch[k].to_numpy() for k in ("row", "least", "most", "n")]
            row, least, most, n = (x.astype("<i8").tobytes() for x in columns)
            values = [b"".join(own), bytes(map(len, own)), row, least, bytes(len(row)), most, n]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in values], ["data", "sizes", "rows", "ids", "starts", "most", "n"])

    found = strings.mapInArrow(lean(combine), "string binary, least long, most long, n long")
    kinds = found.groupBy("string").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).withColumn("row", F.monotonically_increasing_id())
    return staged(kinds.mapInArrow(lean(pack, WINDOWS), "data binary, sizes binary, rows binary, ids binary, starts binary, most binary, n binary"), "kinds")


def _hot_marked(strings: DataFrame, n: int) -> DataFrame:
    """Packed spans of the windows that a document of a smaller id has too.

    Equal strings are cut into windows once. Up to ``LOOKUP`` different windows that two documents have are sent to every task and looked up there; more
    are joined.
    """
    kinds = _hot_kinds(strings)
    windows = _hot_windows(kinds, "most")
    least = staged(windows.groupBy("window").agg(F.min("id").alias("least"), F.max("most").alias("most"), F.count("*").alias("n")), "least")
    again = least.where("least < most")
    if again.count() > LOOKUP:
        return _hot_joined(strings, kinds, windows.select("window", "row", "start"), again.select("window", "least", "n"), n)
    found = again.select("window", "least").collect()
    known = np.array([bytes(r["window"]) for r in found], f"S{LENGTH}")  # all are as long, so that zeros at an end, which numpy leaves out, make no two alike
    order = np.argsort(known)
    table = strings.sparkSession.sparkContext.broadcast((known[order], np.array([r["least"] for r in found], np.int64)[order]))

    def looked_up(batches):
        known, least = table.value
        for batch in batches:
            for data, size, rows, ids, starts in _unpacked(batch) if len(known) else ():
                first, kind = _alike(data, size)
                begin, own = np.cumsum(size) - size, size[first]
                place = np.cumsum(own - LENGTH + 1) - (own - LENGTH + 1)
                smallest = np.full(int((own - LENGTH + 1).sum()), NO_ID)
                for i, go, flat in _cut_windows(data[spans(begin[first], own)], own):
                    window = flat.view(f"S{LENGTH}")
                    at = np.minimum(np.searchsorted(known, window), len(known) - 1)
                    smallest[place[i] + go] = np.where(known[at] == window, least[at], NO_ID)
                yield from _packed_spans(*_gone(smallest, place[kind], size, rows, ids, starts), n).to_batches()

    return strings.mapInArrow(lean(looked_up), "bucket long, keys binary, vals binary")


def _hot_joined(strings: DataFrame, kinds: DataFrame, windows: DataFrame, again: DataFrame, n: int) -> DataFrame:
    """``_hot_marked`` by joins: each kind of string learns the smallest documents of its windows, each string those of its kind."""

    def kind(batches):
        for batch in batches:
            for data, size, rows, _, _, times in _unpacked(batch, "n"):
                yield pa.RecordBatch.from_arrays([_binaries(data, size), pa.array(rows), pa.array(times)], ["string", "row", "n"])

    def string(batches):
        for batch in batches:
            for data, size, rows, ids, starts in _unpacked(batch):
                yield pa.RecordBatch.from_arrays([_binaries(data, size), pa.array(rows), pa.array(ids), pa.array(starts)], ["string", "row", "id", "start"])

    def mark(batches):
        for batch in batches:
            size = np.array([len(x) for x in batch["string"].to_pylist()], np.int64)
            marks = batch["marks"]
            place = np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1)
            smallest = np.full(int((size - LENGTH + 1).sum()), NO_ID)
            own = marks.flatten()
            smallest[np.repeat(place, marks.value_lengths().to_numpy()) + own.field("start").to_numpy()] = own.field("least").to_numpy()
            yield from _packed_spans(*_gone(smallest, place, size, *[batch[k].to_numpy() for k in ("row", "id", "start")]), n).to_batches()

    marks = spread_join(windows, again, "window", "n").groupBy("row").agg(F.collect_list(F.struct("start", "least")).alias("marks"))
    marked = staged(kinds.mapInArrow(lean(kind), "string binary, row long, n long").join(marks, "row").select("string", "marks", "n"), "marks")
    found = spread_join(strings.mapInArrow(lean(string), "string binary, row long, id long, start long"), marked, "string", "n")
    return found.select("string", "row", "id", "start", "marks").mapInArrow(lean(mark, 1 << 14), "bucket long, keys binary, vals binary")


def _sorted_places(text: np.ndarray) -> np.ndarray:
    """The places of a text in order of the ``LENGTH`` symbols from there: sorted by the first eight, then what is still alike by the next."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH + 8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    place = np.argsort(key)
    key, group, at = key[place], np.zeros(n, np.int64), np.arange(n)
    for skip in range(8, LENGTH + 8, 8):
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        alike = ~(new & np.append(new[1:], True))
        at, group = at[alike], np.cumsum(new)[alike]
        if not len(at) or skip >= LENGTH:
            break
        own = place[at]
        key = np.ndarray((n,), ">u8", padded, offset=skip, strides=(1,))[own].astype(np.uint64)
        key >>= np.uint64(8 * max(0, skip + 8 - LENGTH))
        order = np.lexsort((key, group))
        place[at], key = own[order], key[order]
    return place


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, last-to-first map, place of each row) of a shard: strings of symbols from 1, each ended by a 0.

    Rows are in order of their first ``LENGTH`` symbols. The symbol of a string's first place is 0.
    """
    n = len(text)
    place = _sorted_places(text).astype(np.int32)
    row = np.empty(n, np.int32)
    row[place] = np.arange(n, dtype=np.int32)
    before = np.concatenate([[0], text[:-1]]).astype(np.uint8)
    return before[place], row[np.maximum(place - 1, 0)], place


def repeated(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms; (place in the shards laid end to end, interval) of each start of a repeated ``LENGTH``-byte string."""
    made, base, symbols, back, place = [shard_transform(s) for s in shards], 0, [], [], []
    for s, (b, f, p) in zip(shards, made, strict=True):
        symbols.append(b)
        back.append(f + base)
        place.append(p + base)
        base += len(s)
    symbols, back, place = np.concatenate(symbols), np.concatenate(back), np.concatenate(place)
    # A step goes back by two symbols, the farther one first in order: LENGTH is even. Both stand beside the row that they lead to, for one lookup a step.
    farther = np.where(symbols > 0, symbols[back], 0).astype(np.int64)
    steps = back[back].astype(np.int64) << 16 | farther << 8 | symbols
    # Rows that fewer than LENGTH symbols of their string stand before would all drop out on the way.
    size = np.diff(np.flatnonzero(np.concatenate(shards) == 0), prepend=-1)
    depth = np.arange(base) - np.repeat(np.cumsum(size) - size, size)
    row = np.flatnonzero(depth[place] >= LENGTH).astype(np.int32)
    interval = np.zeros(len(row), np.int32)
    for _ in range(LENGTH // 2):
        step = steps[row]
        symbol = step.astype(np.uint16)  # the low sixteen bits
        order = np.argsort(symbol, kind="stable")
        order = order[np.searchsorted(symbol[order], 1 << 8) :]  # less than two symbols stand before the place
        symbol, was = symbol[order], interval[order]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        keep = ~(new & np.append(new[1:], True))  # rows alone in their interval drop out
        row, interval = (step[order[keep]] >> 16).astype(np.int32), np.cumsum(new[keep], dtype=np.int32)
        if not len(row):
            break
    return place[row], interval


def _alike(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first string of each kind, the kind of each string) for strings laid end to end."""
    most = int(sizes.max())
    table = np.zeros((len(sizes), most), np.uint8)
    table[np.arange(most) < sizes[:, None]] = data + 1  # UTF-8 has no byte above 0xF4
    _, first, kind = np.unique(table.view(f"V{most}").ravel(), return_index=True, return_inverse=True)
    return first, kind


def _marked(data, sizes, rows, ids, starts):
    """(row, first, end) of the spans that go, for the strings of one bucket."""
    sizes = sizes.astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    first, kind = _alike(data, sizes)
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, kind, ids)
    width = sizes[first] + 1
    place = np.cumsum(width) - width
    text = np.zeros(int(width.sum()), np.uint8)
    text[spans(place, sizes[first])] = data[spans(begin[first], sizes[first])] + 1
    cut = np.unique(np.searchsorted(place, np.arange(0, len(text), SHARD)))
    shards = np.split(text, place[cut[(cut > 0) & (cut < len(place))]])
    where, interval = repeated(shards)
    smallest = np.repeat(least, width)
    if len(where):
        edge = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        low = np.minimum.reduceat(smallest[where], edge)
        smallest[where] = low[interval - interval[0]]
    return _gone(smallest, place[kind], sizes, rows, ids, starts)


def _gone(smallest, place, sizes, rows, ids, starts):
    """(row, first, end) of the spans that go: windows whose smallest documents, those of a string from its ``place`` on, come before its own."""
    windows = sizes - LENGTH + 1
    occurrence = np.repeat(np.arange(len(sizes)), windows)
    step = np.arange(len(occurrence)) - np.repeat(np.cumsum(windows) - windows, windows)
    goes = np.flatnonzero(smallest[place[occurrence] + step] < ids[occurrence])
    if not len(goes):
        return rows[:0], starts[:0], starts[:0]
    occurrence, step = occurrence[goes], step[goes]
    new = np.ones(len(goes), bool)
    new[1:] = (occurrence[1:] != occurrence[:-1]) | (step[1:] != step[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(goes)) - 1
    o = occurrence[a]
    return rows[o], starts[o] + step[a], starts[o] + step[b] + LENGTH


def _marked_by_block(data, sizes, rows, ids, starts, parts):
    """``_marked`` of a bucket, block by block; strings with one minimizer are of one block."""
    blocks = min(256, -(-len(data) // BLOCK))
    size = sizes.astype(np.int64)
    begin = np.cumsum(size) - size
    found = [_marked(data[spans(begin[i], size[i])], sizes[i], rows[i], ids[i], starts[i]) for _, i in _dealt(parts.astype(np.int64) * blocks >> 8, blocks)]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _packed_spans(rows, low, high, n: int):
    return _packed(rows.astype("<i8"), np.ascontiguousarray(np.stack([low, high], 1).astype("<i8")).view("V16").ravel(), n)


def _marked_strings(strings: DataFrame, n: int) -> DataFrame:
    """Packed spans of the strings that go, bucket by bucket."""

    def mark(group):
        kinds = (("data", np.uint8), ("sizes", np.uint8), ("rows", "<i8"), ("ids", "<i8"), ("starts", "<i8"), ("parts", np.uint8))
        rows, low, high = _marked_by_block(*[np.frombuffer(b"".join(group[k].to_pylist()), t) for k, t in kinds])
        return _packed_spans(rows, low, high, n)

    return strings.groupBy("bucket").applyInArrow(mark, "bucket long, keys binary, vals binary")


def united(pairs: bytes) -> list[tuple[int, int]]:
    """Spans as pairs of 64-bit integers -> disjoint, ascending spans; those that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(np.frombuffer(pairs, "<i8").reshape(-1, 2).tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_texts: int = HOT_TEXTS) -> DataFrame:
    """For each distinct (id, text): id, digest (MD5 of the text), vals: the spans to remove (null: none), packed; staged."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    known = staged(rows.select("doc_id", "digest", F.octet_length("text").alias("n")).distinct().withColumn("row", F.monotonically_increasing_id()), "texts")
    order = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), "row", "doc_id", "n")
    firsts = staged(known.groupBy("digest").agg(F.min(order).alias("x")).select("digest", "x.row", "x.doc_id", "x.n"), "firsts")  # the smallest document of each text
    total, texts = firsts.agg(F.sum("n"), F.count("*")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // BUCKET_BYTES))
    own = lambda of: rows.join(of.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), *of.columns[2:]), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).drop("id", "d")
    share = min(1.0, SAMPLE_TEXTS / max(texts, 1))
    part = (F.octet_length("text") >= LENGTH) & (F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = own(firsts.where(F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "digest")).where(part)
    twice = _repeats(docs, id_col)
    sample = sample.dropDuplicates(["digest"]) if twice else sample
    hot = spark.sparkContext.broadcast(_hot_minimizers(sample, max(HOT_SAMPLED, hot_texts * share) if share < 1 else hot_texts))
    shared = staged(_shared_minimizers(rows.where(F.octet_length("text") >= LENGTH), n, hot), "shared")
    wanted = firsts.join(shared, F.col("digest") == F.col("key")).select("doc_id", "digest", "row", "vals")
    candidates = own(wanted)
    candidates = (candidates.dropDuplicates(["row"]) if twice else candidates).select("row", "doc_id", "text", "vals")
    strings = _strings(candidates, n, hot)
    if len(hot.value):
        strings = staged(strings, "strings")
        marked = _marked_strings(strings.where(F.col("bucket") < n), n).unionByName(_hot_marked(strings.where(F.col("bucket") == n), n))
    else:
        marked = _marked_strings(strings, n)
    found = staged(_by_key(marked, 16, False), "spans")
    others = known.join(firsts.select("row"), "row", "left_anti").select("doc_id", "digest", (F.col("n") >= LENGTH).alias("whole"), F.lit(None).cast("binary").alias("vals"))
    first = firsts.join(found, F.col("row") == F.col("key"), "left").select("doc_id", "digest", F.lit(False).alias("whole"), "vals")
    return staged(first.unionByName(others), "removals")


def _repeats(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(id_col).count().where("count > 1").limit(1).count() > 0


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __whole and __spans added."""
    out = removals(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("whole").alias("__whole"), F.col("vals").alias("__spans"))
    own = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))
    return docs.join(out, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__digest")), "left").drop("__id", "__digest")


def _kept_parts(text, whole, pairs) -> tuple[bytes, int, int, int]:
    """(remaining bytes, bytes, bytes removed, spans removed)."""
    raw = (text or "").encode()
    gone = [(0, len(raw))] if whole else united(pairs) if pairs else []
    edge = [0, *[x for s in gone for x in s], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)), len(raw), sum(b - a for a, b in gone), len(gone)


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            parts = [_kept_parts(t, w, s) for t, w, s in zip(*[batch[k].to_pylist() for k in ("text", "__whole", "__spans")], strict=True)]
            columns = [pa.array([p[k] for p in parts], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array([hashlib.sha256(p[0]).hexdigest() for p in parts], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(only, "doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated bytes gone from their text; a character cut in part goes whole. Rows stay, even if their text is then empty.

    ``length_col`` is set to the new number of characters.
    """

    def rest(whole, pairs, text):
        return _kept_parts(text, whole, pairs)[0].decode(errors="ignore")

    def run(batches):
        for batch in batches:
            texts = [None if t is None else rest(w, s, t) for t, w, s in zip(batch[text_col].to_pylist(), batch["__whole"].to_pylist(), batch["__spans"].to_pylist(), strict=True)]
            names = [c for c in batch.schema.names if c not in ("__whole", "__spans")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch[c] for c in names], names)

    out = _with_spans(docs, id_col, text_col).mapInArrow(lean(run), docs.schema)
    return out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out

"""Exact dedup by a tree merge of sorted digest runs.

Every partition turns its rows into a run sorted by the SHA-256 digest of the normalised text. Partitions then exchange runs in
rounds: numbered in base ``FAN``, partition ``p`` sends in round ``r`` the entries whose digest has the digit ``d`` in place
``r`` to the partition whose number is ``p`` with its own digit in that place replaced by ``d`` (a round for a fan of 4 is two of the binomial
exchange by halves). Each receiver merges the sorted runs that reach it, without sorting again, and keeps, of the entries whose 32 bytes of digest agree,
the smallest identifier and the number of rows. After log_FAN(partitions) rounds equal digests have met and no task has held
more than about one partition's share: a group of any size is one entry in each run, so a hot text never gathers in one place; its rows
then meet their group by broadcast (``spread_join``).

Defined cases: a null text counts as empty; among rows with equal text the smallest id stays, null ids last, and of rows that
share that id exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, lean, ship, spread_join, staged

BITS = 2
FAN = 1 << BITS
RUN_ROWS = 1 << 18
_BLOCK = "slot long, digests binary, ids binary, rows binary, counts binary"
_NO_ID = np.iinfo(np.int64).max


def text_digest(text_col: str = "text"):
    """SHA-256 (lower-case hex) of the text with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACE_RUN, " "), 256)


def _first_of_each(words, ids, rows, counts):
    """Of entries in order of digest, id and row: the first of each digest, with the summed counts. All 32 bytes are compared."""
    if not len(ids):
        return words, ids, rows, counts
    first = np.ones(len(ids), bool)
    first[1:] = (words[1:] != words[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return words[at], ids[at], rows[at], np.add.reduceat(counts, at)


def _sorted_run(words, ids, rows, counts):
    order = np.lexsort((rows, ids, words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    return _first_of_each(words[order], ids[order], rows[order], counts[order])


def _two(a, b):
    """Merge two runs, each in order with one entry for each digest: every entry's place is its own plus what goes before it of the other run."""
    key = lambda run: np.ascontiguousarray(run[0].astype(">u8")).view("S32").ravel()
    left, right = key(a), key(b)
    low, high = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
    at = np.minimum(low, max(len(left) - 1, 0))
    smaller = (b[1] < a[1][at]) | ((b[1] == a[1][at]) & (b[2] < a[2][at])) if len(left) else np.zeros(len(right), bool)
    place = np.where(smaller, low, high) + np.arange(len(right))
    rest = np.ones(len(left) + len(right), bool)
    rest[place] = False
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.empty((len(x) + len(y), *x.shape[1:]), x.dtype)
        both[rest], both[place] = x, y
        out.append(both)
    return _first_of_each(*out)


def merged(runs: list):
    """Multiway merge of sorted runs in a tournament: of entries with one digest the smallest (id, row) wins each match, and counts add up."""
    runs = runs or [(np.zeros((0, 4), np.uint64), *[np.zeros(0, np.int64)] * 3)]
    while len(runs) > 1:
        runs = [_two(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0]


def _blocks(p: int, place: int, places: int, words, ids, rows, counts):
    """The run of partition ``p``, cut by the digest's digit in ``place`` into what goes to each partner."""
    shift = np.uint64(64 - BITS * (place + 1))
    digit = ((words[:, 0] >> shift) & np.uint64(FAN - 1)).astype(np.int64)
    weight = FAN ** (places - 1 - place)
    base = p - (p // weight % FAN) * weight
    out = {k: [] for k in ("slot", "digests", "ids", "rows", "counts")}
    for d in np.unique(digit):
        at = np.flatnonzero(digit == d)
        out["slot"].append(base + int(d) * weight)
        out["digests"].append(words[at].astype(">u8").tobytes())
        for k, v in (("ids", ids), ("rows", rows), ("counts", counts)):
            out[k].append(v[at].tobytes())
    kinds = (pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def _runs(group) -> list:
    """The runs of a group's rows, each in order as it was cut."""
    kinds = (("digests", ">u8"), ("ids", "<i8"), ("rows", "<i8"), ("counts", "<i8"))
    rows = zip(*[group[k].to_pylist() for k, _ in kinds], strict=True)
    return [(np.frombuffer(w, ">u8").reshape(-1, 4).astype(np.uint64), *[np.frombuffer(x, "<i8") for x in rest]) for w, *rest in rows]


def _leaf(places: int):
    def run(batches):
        from pyspark import TaskContext

        p = TaskContext.get().partitionId() % FAN**places
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= RUN_ROWS:
                yield _leaf_run(held, p, places)
                held, n = [], 0
        if n:
            yield _leaf_run(held, p, places)

    return run


def _leaf_run(held, p, places):
    t = pa.Table.from_batches(held)
    words = np.frombuffer(b"".join(t["digest"].to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)
    ids = t["doc_id"].fill_null(int(_NO_ID)).to_numpy().astype(np.int64)
    rows = t["row"].to_numpy().astype(np.int64)
    return _blocks(p, 0, places, *_sorted_run(words, ids, rows, np.ones(len(ids), np.int64)))


def _round(place: int, places: int):
    def merge(key, group):
        words, ids, rows, counts = merged(_runs(group))
        if place < places:
            return pa.Table.from_batches([_blocks(key[0].as_py(), place, places, words, ids, rows, counts)])
        raw = words.astype(">u8").tobytes()
        return pa.table({"digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), "keep_id": pa.array(ids, mask=ids == _NO_ID), "keep_row": rows, "group_size": counts})

    return merge


def groups(digests: DataFrame) -> DataFrame:
    """(doc_id, row, digest) -> one row per digest: digest, keep_id, keep_row, group_size."""
    spark = digests.sparkSession
    ship(spark)
    n = max(digests.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = 1
    while FAN**places < n:
        places += 1
    runs = digests.mapInArrow(lean(_leaf(places), RUN_ROWS), _BLOCK)
    for place in range(1, places + 1):
        last = place == places
        runs = runs.groupBy("slot").applyInArrow(_round(place, places), "digest binary, keep_id long, keep_row long, group_size long" if last else _BLOCK)
    return runs


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept."""
    digests = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(text_digest(text_col)).alias("digest"))
    digests = staged(digests, "digests")
    found = spread_join(digests, staged(groups(digests), "groups"), "digest", "group_size")
    return found.select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _labelled(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = staged(_labelled(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__stay_id"), F.col("digest").alias("__stay_digest")), "stay")
    # rows without an id are dealt by their digest, not to one task
    deal = lambda i, d: F.coalesce(i, F.xxhash64(d))
    own = docs.withColumns({"__id": F.col(f"`{id_col}`").cast("long"), "__digest": F.unhex(text_digest(text_col))})
    own = own.withColumn("__deal", deal(F.col("__id"), F.col("__digest")))
    # Only a table with repeated ids can hold two rows with one id and one text.
    if docs.groupBy(id_col).count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(["__deal", "__id", "__digest"])
    stay = stay.withColumn("__stay_deal", deal(F.col("__stay_id"), F.col("__stay_digest")))
    on = (F.col("__deal") == F.col("__stay_deal")) & F.col("__id").eqNullSafe(F.col("__stay_id")) & (F.col("__digest") == F.col("__stay_digest"))
    return own.join(stay, on, "left_semi").drop("__id", "__digest", "__deal")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""

"""Near dedup by consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text is a bag of five-word shingles. A shingle weighs its count times a damped inverse document frequency. Frequencies are
counted over all documents in a table of ``SLOTS`` hashed counters, whose size does not grow with the corpus (the share of documents that fall into a
slot by chance doesn't either). The damping bounds the ratio of two weights to 1.25: undamped, the text that a large group of
near copies shares weighs next to nothing and the group falls apart. Of 2,490 pairs of a group of some thousand near copies with a plain Jaccard
similarity of ``THRESHOLD`` or more, 2,275 reach it damped so, 1,623 with half the damping and 523 with none.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each text, its random numbers taken from a table of draws; texts that
agree in a band share a bucket. A bucket is never expanded into all its pairs. Every member is paired with the bucket's pivot, if their weights
allow a similarity of ``THRESHOLD``; verified pairs join classes. Texts with equal word sequences are one candidate from the start.

The texts of buckets that still hold two classes are then joined exactly, by prefixes. Shingles are put in order, rare ones first. If the similarity of two texts
reaches ``THRESHOLD``, what follows from their first common shingle on weighs enough in both to hold the overlap that this takes; so it is among the first of each, and two
texts that share only what many share never meet. First, ``PIVOT_ROUNDS`` times, each text is tried against at most ``TRIES`` of the pivots of its shingles, which
joins the near copies of a large group into one class by a number of pairs that grows with the texts. The last step takes every pair in two classes
that meets that bound, so no link between candidates is lost.

Defined cases: null and empty texts are one class; texts under five words have one shingle of all their words; rows that share
an id each keep a row of their own; null ids count as largest; of each class one row is kept, that of the smallest id, digest and place; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import chunks, lean, ship, spread_join, staged
from .shingles import digest, lowered, mixed, shingles

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 4
SLOTS, BLOCKS = 1 << 20, 64
DAMP = 0.2
PIVOT_ROUNDS, PIVOTS, TRIES = 2, 32, 16
_DRAWS = 1 << 16
_TILE = 2048
#: Ranges of the weight of a shingle that stands once, for which draws are worked out beforehand: 0.5 MB each.
_RANGES = 16
_UNKNOWN = np.uint64(2**64 - 1)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents counted in each slot, all documents); what reaches the driver is ``SLOTS`` numbers, whatever the corpus."""

    def count(batches):
        slots, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            texts = lowered(batch["text"].to_pylist())
            for a, b in chunks(texts):
                slots += np.bincount((shingles(texts[a:b], WIDTH)[1] >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
            n += len(texts)
        parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(slots, BLOCKS)]
        yield pa.RecordBatch.from_pydict({"block": list(range(BLOCKS)), "slots": parts, "n": [n] * BLOCKS})

    def add(group):
        total = sum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in group["slots"].to_pylist())
        return pa.table({"block": group["block"][:1], "slots": [total.astype("<i8").tobytes()], "n": [sum(group["n"].to_pylist())]})

    made = docs.select("text").mapInArrow(lean(count), "block long, slots binary, n long").groupBy("block").applyInArrow(add, "block long, slots binary, n long")
    rows = sorted(made.collect())
    if not rows:
        return np.zeros(SLOTS, np.int64), 0
    return np.concatenate([np.frombuffer(r["slots"], "<i8") for r in rows]), rows[0]["n"]


def damped_idf(slots: np.ndarray, n: int) -> np.ndarray:
    idf = np.log1p(n / np.maximum(slots, 1))
    return (1 - DAMP + DAMP * idf / max(float(np.log1p(n)), 1e-9)).astype(np.float32)


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of the sampling scheme: r and c from a gamma law of shape 2, beta even over [0, 1)."""
    rng = np.random.default_rng(20100)
    r, c = rng.gamma(2.0, 1.0, _DRAWS), rng.gamma(2.0, 1.0, _DRAWS)
    return r.astype(np.float32), np.log(c).astype(np.float32), rng.random(_DRAWS).astype(np.float32)


def _drawn(pick: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """What the draws ``pick`` give a weight: in the high half a number that orders as ln a does, in the low half a code of t."""
    r, ln_c, beta = _draws()
    rk, bk = r[pick], beta[pick]
    t = np.floor(log_w / rk + bk)
    ln_a = ln_c[pick] - rk * (t - bk + np.float32(1))
    bits = ln_a.view(np.uint32)
    rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # orders as the floats do
    return (rank.astype(np.uint64) << np.uint64(32)) | (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))


@functools.cache
def _known_draws() -> tuple[np.ndarray, np.ndarray]:
    """(edges of the ranges of ln w, what each draw gives each range); made once, 8.5 MB.

    t does not fall as the weight grows, in floating point neither, and what a draw gives hangs on the weight by t alone. So a draw whose t is one at both
    edges of a range gives all weights between the same; the others are ``_UNKNOWN``, as all are in the last row, that of weights in no range.
    """
    edges = np.linspace(np.log(1 - DAMP), 0, _RANGES + 1).astype(np.float32)
    at_edge = np.stack([_drawn(np.arange(_DRAWS), e) for e in edges])
    known = np.full((_RANGES + 1, _DRAWS), _UNKNOWN)
    known[:-1] = np.where(at_edge[:-1] == at_edge[1:], at_edge[:-1], _UNKNOWN)
    return edges, known.ravel()


def samples(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The samples of texts 0..n-1 as a matrix of 32-bit codes; ``doc`` ascends. Rows of texts without shingles are 0."""
    hashes = BANDS * ROWS
    out = np.zeros((n, hashes), np.uint32)
    rng = np.random.default_rng(7)
    odd = rng.integers(1, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    edges, known = _known_draws()
    log_w = np.log(weight).astype(np.float32)
    span = np.where(log_w == edges[-1], _RANGES, np.searchsorted(edges, log_w, "right")) - 1
    span[(span < 0) | (span > _RANGES)] = _RANGES
    base = span.astype(np.uint64) * np.uint64(_DRAWS)
    code = (value >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    best = np.full((n, hashes), np.uint64(2**64 - 1))
    for a in range(0, len(doc), _TILE):
        part = slice(a, min(a + _TILE, len(doc)))
        pick = value[part, None] * odd
        pick >>= np.uint64(48)
        pick += base[part, None]
        both = known.take(pick.view(np.int64))
        left = np.flatnonzero(both == _UNKNOWN)
        both.reshape(-1)[left] = _drawn((pick.reshape(-1)[left] % np.uint64(_DRAWS)).astype(np.int64), log_w[part][left // hashes])
        both ^= code[part, None]
        cut = np.concatenate([[a], begins[(begins > a) & (begins < part.stop)]])
        least = np.minimum.reduceat(both, cut - a, axis=0)
        best[doc[cut]] = np.minimum(best[doc[cut]], least)
    has = doc[begins]
    out[has] = best[has].astype(np.uint32)
    return out


def bands(codes: np.ndarray) -> np.ndarray:
    """A 64-bit bucket of each band, the band's number mixed in."""
    out = np.zeros((len(codes), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(codes), b + 1, np.uint64)
        for k in range(ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[:, b * ROWS + k])
        out[:, b] = h
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, row (a number of its own), same (digest of the word sequence), weight, buckets (null without shingles); staged."""
    table = docs.sparkSession.sparkContext.broadcast(idf)  # SLOTS floats: 4 MB

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = lowered(batch["text"].to_pylist())
            total, found = [], []
            for a, b in chunks(texts):
                part = texts[a:b]
                doc, value, times = shingles(part, WIDTH)
                weight = times * table.value[(value >> np.uint64(44)).astype(np.int64)]
                total.append(np.bincount(doc, weight, len(part)))
                found.append(bands(samples(doc, value, weight, len(part))).view(np.int64))
            total = np.concatenate(total) if total else np.zeros(0)
            flat = np.concatenate(found).reshape(-1) if found else np.zeros(0, np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), BANDS).cast(pa.list_(pa.int64()))
            numbers = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], numbers, pa.array(map(digest, texts), pa.binary()), pa.array(total, pa.float64()), lists], ["doc_id", "row", "same", "weight", "buckets"])

    return staged(docs.mapInArrow(lean(run), "doc_id long, row long, same binary, weight double, buckets array<long>"), "signatures")


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (shingles ascending, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - low
    return low / whole if whole else 1.0


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar enough."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            vectors = {}
            every = dict(zip(batch["a"].to_pylist() + batch["b"].to_pylist(), batch["text_a"].to_pylist() + batch["text_b"].to_pylist(), strict=True))
            keys, low = list(every), lowered(list(every.values()))
            for x, y in chunks(low):
                doc, value, times = shingles(low[x:y], WIDTH)
                weight = times * table.value[(value >> np.uint64(44)).astype(np.int64)]
                edge = np.searchsorted(doc, np.arange(y - x + 1))
                for k in range(y - x):
                    vectors[keys[x + k]] = value[edge[k] : edge[k + 1]], weight[edge[k] : edge[k + 1]]
            ok = [similarity(vectors[a], vectors[b]) >= THRESHOLD for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("same").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("same").alias("b"), F.col("text").alias("text_b"))
    # a pivot's text, which many pairs need, is joined last: it is shuffled once and its pairs lie side by side
    return pairs.join(right, "b").join(left, "a").mapInArrow(lean(run), "a binary, b binary")


def classes(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, label (the smallest node), by label spreading with shortcuts.

    Each round takes the smallest label among neighbours, then the label of that label, until nothing changes; all in staged tables.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        hop = labels.select(F.col("node").alias("to"), F.col("label").alias("hop"))
        moved = staged(step.join(hop, "to").select("node", F.least("to", "hop").alias("label"), "was"), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").limit(1).count() == 0:
            return labels


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the class's smallest doc_id), class_size, kept (one row of each class)."""
    return _labelled_rows(docs, id_col, text_col)[0].select("doc_id", "class_id", "class_size", "kept")


def _labelled_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """The rows of ``label`` with same, and whether an id (null included) occurs twice."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    idf = damped_idf(*frequencies(rows))
    signed = signatures(rows, idf)
    nodes = signed.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("buckets").alias("buckets"))
    members = nodes.where("weight > 0").select("same", "doc_id", "weight", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = staged(members.join(shared, "bucket"), "members")
    twice = signed.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    texts = _texts_of(rows, members.select("same", "doc_id").distinct(), twice)
    tried = staged(_star(members), "pairs")
    links = staged(verified(tried, texts, idf), "found")
    labels = classes(links)
    keyed = _prefixes(_apart(members, labels), texts, idf)
    for turn in range(PIVOT_ROUNDS + 1):
        now = _keys_apart(keyed, labels)
        if now.limit(1).count() == 0:
            break
        pairs = _pivots(now, turn) if turn < PIVOT_ROUNDS else _across(now)
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        links = links.union(staged(verified(pairs, texts, idf), "found"))
        labels = classes(links)
    named = signed.select("doc_id", "row", "same").join(labels.withColumnRenamed("node", "same"), "same", "left").withColumn("label", F.coalesce("label", "same"))
    named = staged(named, "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "same", "row"))
    sizes = named.groupBy("label").agg(first.alias("first"), F.count("*").alias("class_size"))
    sizes = staged(sizes.select("label", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"), "class_size"), "classes")
    return spread_join(named, sizes, "label", "class_size").select("doc_id", "same", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("kept")), twice


def _keyed(docs: DataFrame, text: str, name: str) -> DataFrame:
    """All columns, and as ``name`` the digest of the word sequence of the column ``text``."""

    def run(batches):
        for batch in batches:
            yield batch.append_column(name, pa.array(map(digest, lowered(batch[text].to_pylist())), pa.binary()))

    return docs.mapInArrow(lean(run), StructType([*docs.schema, StructField(name, BinaryType())]))


def _texts_of(rows: DataFrame, wanted: DataFrame, twice: bool) -> DataFrame:
    """same, text of the candidates, staged."""
    if twice:  # rows of one id, null above all, would meet each other in a join by id
        return staged(_keyed(rows.select("text"), "text", "same").join(wanted.select("same"), "same", "left_semi").dropDuplicates(["same"]).select("same", "text"), "texts")

    def exact(batches):
        for batch in batches:
            ok = [digest(t) == s for t, s in zip(lowered(batch["text"].to_pylist()), batch["same"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    joined = rows.join(wanted.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of"))).select("same", "text")
    return staged(joined.mapInArrow(lean(exact), "same binary, text string").dropDuplicates(["same"]), "texts")


_FITS = f"least(weight, other) >= {THRESHOLD - 1e-9} * greatest(weight, other)"
#: The share of both texts' weights that their overlap has at least.
_OVERLAP = THRESHOLD / (1 + THRESHOLD) * (1 - 1e-6)
_ENOUGH = f"least(rest, rest_other) >= {_OVERLAP} * (weight + other)"


def _star(members: DataFrame) -> DataFrame:
    """Each member with its bucket's pivot, the member of the smallest digest."""
    pivot = members.groupBy("bucket").agg(F.min(F.struct("same", "weight")).alias("p"))
    pivot = pivot.select("bucket", F.col("p.same").alias("a"), F.col("p.weight").alias("other"))
    return members.join(pivot, "bucket").where("same <> a").where(_FITS).select("a", F.col("same").alias("b")).distinct()


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.withColumnRenamed("node", "same"), "same", "left").withColumn("label", F.coalesce("label", "same"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """same: the members of buckets that hold more than one class."""
    now = _labelled(members, labels)
    split = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return now.join(split, "bucket").select("same").distinct()


def _prefixes(apart: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """same, weight, key, rest: the first shingles of each text, rare ones first, with the weight from there on; staged.

    Those stay for which some text of a fitting weight could meet the bound, and which two texts have.
    """
    table = apart.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            low, same = lowered(batch["text"].to_pylist()), batch["same"]
            for x, y in chunks(low):
                doc, value, times = shingles(low[x:y], WIDTH)
                rarity = table.value[(value >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((value, -rarity, doc))
                doc, value, weight = doc[order], value[order], (times * rarity)[order].astype(np.float64)
                total = np.bincount(doc, weight, y - x)
                ends = np.cumsum(total)[doc]
                rest = ends - np.cumsum(weight) + weight
                at = np.flatnonzero(rest >= THRESHOLD * (1 - 1e-6) * total[doc])
                yield pa.RecordBatch.from_arrays([same.take(pa.array(doc[at] + x)), pa.array(total[doc[at]]), pa.array(value[at].view(np.int64)), pa.array(rest[at])], ["same", "weight", "key", "rest"])

    made = staged(texts.join(apart, "same", "left_semi").select("same", "text").mapInArrow(lean(run), "same binary, weight double, key long, rest double"), "prefixes")
    return staged(made.join(made.groupBy("key").count().where("count > 1").select("key"), "key"), "prefixes")


def _keys_apart(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of shingles that stand in more than one class, with their class; staged."""
    now = _labelled(keyed, labels)
    split = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return staged(now.join(split, "key"), "apart")


def _pivots(now: DataFrame, turn: int) -> DataFrame:
    """Each text with at most ``TRIES`` pivots of its shingles; a shingle has up to ``PIVOTS`` of its texts as pivots, others in each turn.

    These rounds only save pairs: what they leave apart is for ``_across``, which has no such bounds.
    """
    dealt = F.pmod(F.xxhash64("same", F.lit(turn)), F.lit(PIVOTS))
    pivot = now.groupBy("key", dealt).agg(F.min(F.struct(F.xxhash64("key", "same", F.lit(turn)).alias("h"), "same", "label", "weight", "rest")).alias("p"))
    pivot = pivot.select("key", F.col("p.same").alias("a"), F.col("p.label").alias("label_a"), F.col("p.weight").alias("other"), F.col("p.rest").alias("rest_other"))
    met = now.join(pivot, "key").where("label <> label_a").where(_FITS).where(_ENOUGH).select("same", "a").distinct()
    few = Window.partitionBy("same").orderBy(F.xxhash64("a", F.lit(turn)), "a")
    return met.withColumn("k", F.row_number().over(few)).where(F.col("k") <= TRIES).select(F.least("a", "same").alias("a"), F.greatest("a", "same").alias("b")).distinct()


def _across(now: DataFrame) -> DataFrame:
    """The pairs in two classes that meet the bound at a shingle that both have; the lighter text's part is held to the bound for a text of its own weight."""
    light = now.where(f"rest >= {2 * _OVERLAP} * weight").select("key", F.col("same").alias("a"), F.col("weight").alias("other"), F.col("label").alias("label_a"), F.col("rest").alias("rest_other"))
    lighter = (F.col("other") < F.col("weight")) | ((F.col("other") == F.col("weight")) & (F.col("a") < F.col("same")))
    met = light.join(now, (light["key"] == now["key"]) & (F.col("label_a") != F.col("label")) & lighter & F.expr(_FITS) & F.expr(_ENOUGH))
    return met.select(F.least("a", "same").alias("a"), F.greatest("a", "same").alias("b")).distinct()


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns."""
    labelled, twice = _labelled_rows(docs, id_col, text_col)
    stay = staged(labelled.where("kept").select(F.col("doc_id").alias("__stay_id"), F.col("same").alias("__stay_same")), "stay")
    of = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__stay_id"))
    if not twice:
        return docs.join(stay, of, "left_semi")
    # Rows with one id and one word sequence are of one class, and any of them stands for it.
    keyed = _keyed(docs.withColumn("__text", F.col(text_col).cast("string")).withColumn("__id", F.col(id_col).cast("long")), "__text", "__same")
    keyed = keyed.dropDuplicates(["__id", "__same"])
    of = F.col("__id").eqNullSafe(F.col("__stay_id")) & (F.col("__same") == F.col("__stay_same"))
    return keyed.join(stay, of, "left_semi").drop("__text", "__id", "__same")

"""Quality classifier from weak labels.

Heuristic labellers look at each text and vote good, bad or not at all, as DataFrame expressions. Votes are counted by pattern over all documents
(at most 3 ** labellers patterns, whatever the corpus), and expectation-maximisation finds from these counts how often each labeller votes what on good
and bad texts, and each pattern's posterior. A linear scorer over hashed byte trigrams is then trained on the posterior labels of at most about
``TRAIN_TEXTS`` distinct texts, chosen by a hash of the text, and scores every document whole. No given label takes part.

Defined cases: null and empty texts score by the bias alone; repeated rows are scored alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, lean, ship
from .quality_rules import STOP_WORDS, SYMBOLS

#: Bound on the texts that the scorer is trained on; hashed features; passes over the training texts; the score from which a text is kept.
TRAIN_TEXTS, BINS, STEPS, CUT = 4000, 1 << 16, 150, 0.5


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` with what the labellers look at, in steps: a step's columns are worked out once and read by the next. An empty text has nulls among them."""
    text = F.col("text")
    without = lambda pattern: F.try_divide(F.col("chars") - F.char_length(F.regexp_replace(text, pattern, "")), "chars")
    share = lambda test: F.size(F.filter("words", test)) / F.col("n")
    rows = rows.withColumns({"trimmed": F.btrim(text, F.lit(SPACES)), "chars": F.char_length(text).cast("double")})
    rows = rows.withColumns({"words": F.split("trimmed", SPACE_RUN), "lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    rows = rows.withColumn("n", F.size("words").cast("double"))
    return rows.withColumns(
        {
            "empty": F.col("trimmed") == "",
            "stop": share(lambda w: F.lower(w).isin(STOP_WORDS)),
            "symbol": without(f"[{re.escape(SYMBOLS)}]") * F.col("chars") / F.col("n"),
            "letter": share(lambda w: w.rlike(r"\p{L}")),
            "length": F.col("chars") / F.col("n"),
            "capital": without(r"\p{Lu}"),
            "distinct": F.size(F.array_distinct("words")) / F.col("n"),
            "mark": without(r"[!?|]"),
            "ends": F.try_divide(F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))), F.size("lines")),
        }
    )


def _votes() -> dict[str, Column]:
    """Labeller -> 1 (good), -1 (bad) or 0 (no vote), over the columns of ``_measured``."""
    c = F.col
    vote = lambda good, bad: F.when(c("empty"), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")
    never = F.lit(False)
    return {
        "stop_words": vote(c("stop") >= 0.1, (c("stop") < 0.03) & (c("n") >= 20)),
        "symbols": vote(never, c("symbol") > 0.1),
        "letters": vote(never, c("letter") < 0.75),
        "word_length": vote((c("length") >= 5) & (c("length") <= 7.5), (c("length") < 4) | (c("length") > 10)),
        "capitals": vote(c("capital") < 0.08, c("capital") > 0.3),
        "variety": vote((c("distinct") >= 0.6) & (c("n") >= 20), (c("distinct") < 0.4) & (c("n") >= 50)),
        "marks": vote(c("mark") < 0.01, c("mark") > 0.05),
        "sentences": vote(c("ends") >= 0.9, c("ends") < 0.4),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern, and each labeller's vote law, by class: (patterns,), (2, labellers, 3)."""
    good = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))  # the majority starts it, which also fixes which class is which
    law = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for y, p in enumerate((1 - good, good)):
            weight = p * counts
            for v in range(3):
                law[y, :, v] = ((patterns == v - 1) * weight[:, None]).sum(axis=0) + 0.1
        law /= law.sum(axis=2, keepdims=True)
        prior = np.clip((good * counts).sum() / counts.sum(), 0.01, 0.99)
        log = np.log(law)
        at = np.arange(patterns.shape[1])
        odds = np.log(prior / (1 - prior)) + (log[1, at, patterns + 1] - log[0, at, patterns + 1]).sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return good, law


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram of each place, places of each text)."""
    data = np.frombuffer(b"".join(b"\n" + t + b"\n" for t in texts), np.uint8).astype(np.uint32)
    code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 2) - sizes - 2
    owner = np.repeat(np.arange(len(texts)), sizes)
    return code[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))], sizes


def train(rows: list[tuple[bytes, float]], steps: int = STEPS) -> np.ndarray:
    """Weights and bias (last) of a logistic scorer over shares of trigrams, for (bins and counts packed, posterior) of each text."""
    weight, bias = np.zeros(BINS), 0.0
    if not rows:
        return np.append(weight, bias)
    parts = [np.frombuffer(r[0], [("bin", "<u2"), ("share", "<f4")]) for r in rows]
    size = np.array([len(p) for p in parts])
    owner, cell = np.repeat(np.arange(len(rows)), size), np.concatenate(parts)
    at, x, want = cell["bin"].astype(np.int64), cell["share"].astype(float), np.array([r[1] for r in rows])
    slope, square = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for k in range(1, steps + 1):
        z = bias + np.bincount(owner, x * weight[at], len(rows))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) / len(rows)
        grad = np.append(np.bincount(at, x * off[owner], BINS) + 1e-6 * weight, off.sum())
        slope, square = 0.9 * slope + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        step = 0.5 * (slope / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return np.append(weight, bias)


def _features(text: bytes) -> bytes:
    code, _ = trigrams([text])
    cells, n = np.unique(code, return_counts=True)
    out = np.zeros(len(cells), [("bin", "<u2"), ("share", "<f4")])
    out["bin"], out["share"] = cells, n / max(len(code), 1)
    return out.tobytes()


def fit(docs: DataFrame, text_col: str = "text", train_texts: int = TRAIN_TEXTS):
    """(weights with bias, labeller -> vote law by class)."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    votes = _votes()
    names = list(votes)
    rows = docs.select(text.alias("text"))
    voted = _measured(rows).select(*[v.alias(k) for k, v in votes.items()])
    table = voted.groupBy(*names).count().collect()  # a row for each pattern, not for documents
    if not table:
        return np.zeros(BINS + 1), {}
    patterns, counts = np.array([[r[k] for k in names] for r in table]), np.array([r["count"] for r in table], float)
    good, law = expectation_maximisation(patterns, counts)
    posterior = {tuple(p): float(g) for p, g in zip(patterns.tolist(), good, strict=True)}
    share = min(1.0, train_texts / counts.sum())
    hashed = F.xxhash64("text")
    chosen = rows.where(F.pmod(hashed, F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("h", hashed).dropDuplicates(["h"])

    def pack(batches):
        for batch in batches:
            n = batch.num_rows
            labels = list(zip(*[batch[k].to_pylist() for k in names], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([_features(t.encode()) for t in batch["text"].to_pylist()], pa.binary()), pa.array([posterior[x] for x in labels], pa.float64()), batch["h"]], ["x", "y", "h"]) if n else pa.RecordBatch.from_pydict({"x": pa.array([], pa.binary()), "y": pa.array([], pa.float64()), "h": pa.array([], pa.int64())})

    sample = _measured(chosen).select("text", "h", *[v.alias(k) for k, v in votes.items()]).mapInArrow(lean(pack), "x binary, y double, h long").collect()  # train_texts rows
    sample.sort(key=lambda r: r["h"])
    return train([(r["x"], r["y"]) for r in sample]), {k: law[:, i].round(3).tolist() for i, k in enumerate(names)}


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, score (probability of good), kept."""
    ship(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # BINS floats: 256 KB

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            z = []
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                code, sizes = trigrams(part)
                owner = np.repeat(np.arange(len(part)), sizes)
                z.append(table.value[-1] + np.bincount(owner, table.value[:-1][code].astype(float), len(part)) / np.maximum(sizes, 1))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z) if z else np.zeros(0), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p), pa.array(p >= cut)], ["doc_id", "score", "kept"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double, kept boolean")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    weights, _ = fit(docs, text_col)
    return score(docs, weights, id_col, text_col)

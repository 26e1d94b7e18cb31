"""Token ids in flat binary files.

A dataset is a folder of shards and a manifest. ``shard-P-N.bin`` holds the ids of its documents as unsigned little-endian integers
(16 bits where the vocabulary allows it, else 32) with nothing between them; ``shard-P-N.idx`` holds the documents' ids
and 64-bit offsets; ``manifest.json`` holds, for each shard, the ids of all shards before it, a prefix sum over shard totals.
Documents are range-partitioned by id, so shard order is document order, and a reader maps both files into memory. A task streams its ids to the
file at hand and begins a new shard after ``SHARD_BYTES``, so what it holds is one batch and the offsets of one shard.

A word (a run of bytes outside ASCII white space) is encoded once and then taken from a cache: the normaliser and the pattern of
the tokenizer never reach across white space (tested against whole texts), nor do its added tokens, which a text may hold.

Defined cases: a null text counts as empty and holds the end id alone; null document ids come first; rows with the same id are ordered
by text; an empty table gives a dataset without shards; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PieceCache
from .common import lean, new_file, open_fs, put_file, scratch, ship

MAGIC = b"HGTOKIX1"
NO_ID = np.iinfo(np.int64).min
SHARD_BYTES = 256 << 20


class WordEncoder(PieceCache):
    """Ids of texts through a cache of words; new words go to the tokenizer in one batch."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(t.single_word or any(c.isspace() for c in t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has added tokens that reach across words")
        self.vocabulary = self.tokenizer.get_vocab_size()
        super().__init__(None, None)

    def pieces(self, points: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        solid = (points != 32) & ((points < 9) | (points > 13))
        first = np.zeros(len(points) + 1, bool)
        first[firsts] = first[-1] = True
        before = np.concatenate([[False], solid])
        begin = solid & (first[:-1] | ~before[:-1])
        end = solid & (first[1:] | ~np.append(solid[1:], False))
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def _merged(self, text: str, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _index(ids: list[int], offsets: np.ndarray, width: int) -> bytes:
    return MAGIC + np.array([width, len(ids)], "<i8").tobytes() + np.array(ids, "<i8").tobytes() + offsets.astype("<i8").tobytes()


def write(docs: DataFrame, path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Encode and write ``docs`` in ascending id order to the folder ``out``; returns the manifest's shards."""
    spark = docs.sparkSession
    ship(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches):
        from pyspark import TaskContext

        encoder = word_encoder(path)
        kind, width = ("<u2", 2) if max(encoder.vocabulary - 1, end_id) < 1 << 16 else ("<u4", 4)
        p = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        batch, part = next(batches, None), 0
        while batch is not None:
            name, ids, counts, size = f"shard-{p:06d}-{part:06d}", [], [], 0
            with new_file(f"{out}/{name}.bin") as to:
                while batch is not None and size < shard_bytes:
                    for raw in encoder.encode([t or "" for t in batch["text"].to_pylist()]):
                        both = np.frombuffer(raw + end, "<u4").astype(kind)
                        to.write(both.tobytes())
                        counts.append(len(both))
                        size += both.nbytes
                    ids += batch["doc_id"].fill_null(int(NO_ID)).to_pylist()
                    batch = next(batches, None)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            put_file(f"{out}/{name}.idx", _index(ids, offsets, width))
            yield pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(ids)], "n_ids": [int(offsets[-1])]})
            part += 1

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    totals = sorted(ordered.mapInArrow(lean(shard), "name string, n_docs long, n_ids long").collect())  # a row for each shard, not for documents
    shards, base = [], 0
    for name, n_docs, n_ids in totals:
        shards.append({"name": name, "base": base, "n_docs": n_docs, "n_ids": n_ids})
        base += n_ids
    put_file(f"{out}/manifest.json", json.dumps({"format": MAGIC.decode(), "end_id": end_id, "n_ids": base, "shards": shards}).encode())
    return shards


def _mapped(uri: str) -> np.ndarray:
    """The file's bytes, mapped where it lies in a mounted folder."""
    from pyarrow import fs

    files, at = open_fs(uri)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(at, np.uint8, "r")
    with files.open_input_file(at) as f:
        return np.frombuffer(f.read(), np.uint8)


def read_shard(folder: str, name: str):
    """(document ids, offsets, ids) of one shard; nothing is copied."""
    raw = _mapped(f"{folder}/{name}.idx")
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"{name}.idx is not a token index")
    width, n = (int(x) for x in raw[8:24].view("<i8"))
    body = raw[24:].view("<i8")
    return body[:n], body[n:], _mapped(f"{folder}/{name}.bin").view(f"<u{width}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids), shard."""
    ship(spark)
    files, at = open_fs(f"{folder}/manifest.json")
    with files.open_input_stream(at) as f:
        shards = json.loads(f.read())["shards"]

    def scan(batches):
        for batch in batches:
            for name, base in zip(batch["name"].to_pylist(), batch["base"].to_pylist(), strict=True):
                ids, offsets, tokens = read_shard(folder, name)
                for k in range(0, len(ids), 1 << 14):
                    own, at = np.array(ids[k : k + (1 << 14)]), offsets[k : k + (1 << 14) + 1]
                    crc = [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(base + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array([name] * len(own))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    listed = spark.createDataFrame([(s["name"], s["base"]) for s in shards], "name string, base long").repartition(max(1, len(shards)))
    return listed.mapInArrow(lean(scan), "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def write_and_read(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    out = scratch(docs.sparkSession, "tokens")
    write(docs, path, out, end_id)
    return read(docs.sparkSession, out)

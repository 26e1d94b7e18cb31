"""Operators against brute force, libraries and round trips, with nulls, empty and long texts, ties, empty tables and clashing columns."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hedgerow.llm import bpe, classifier, exact_dedup, licenses, near_dedup, packing, quality_rules, suffix_dedup, token_files, warc
from hedgerow.llm.common import scratch, scratch_root

TEXTS = [
    "the cat's  toy isn't here\n\n and we've   seen it 123 times!! 'll ''s x'sy",
    None,
    "",
    "   ",
    "Grüße an die Straße – 東京 ٣٤ é   x \U0001f600",
    "a" * 30_000,
    "word " * 4000,
    "the cat's toy isn't here and we've seen it 123 times!! 'll ''s x'sy",
    "\t\n tab \r\n line\x0bfeed\x85next",
]
SCHEMA = "doc_id long, text string, digest string, row long, kept string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab's'tre ve'll\n\t  .!1٣é東́ \U0001f600d"), max_size=40), max_size=5))
def test_bpe_equals_tiktoken(tik, texts):
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    for t, raw in zip(texts, c.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == tik.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_scan_is_the_sequential_machine():
    rng = np.random.default_rng(1)
    steps = rng.choice([bpe.WORD_STEP, bpe.OPEN_STEP, bpe.SHORT_STEP, bpe.LONG_STEP, bpe.IDENTITY], 5000).astype(np.uint8)
    state, want = 0, []
    for f in steps.tolist():
        state = (f >> (2 * state)) & 3
        want.append(state)
    assert bpe.states_after(steps).tolist() == want


def test_bpe_frames(spark, docs, tik):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    for r in bpe.round_trip(docs, path).collect():
        t = TEXTS[r.doc_id] or ""
        ids = np.array(tik.encode_ordinary(t), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    encoded = bpe.encode(docs, path)
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, path).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    for r in encoded.collect():
        assert len(r.offsets) == len(r.ids) and (not r.offsets or r.offsets[0] == 0)
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_exact_dedup(spark, docs):
    import re

    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    got = {r.doc_id: r for r in exact_dedup.label(docs).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), i == same[0])
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.label(docs.limit(0)).count() == 0
    twice = table(spark, ["same"] * 50).withColumn("doc_id", F.lit(None).cast("long"))
    out = exact_dedup.label(twice).collect()
    assert len(out) == 50 and sum(r.kept for r in out) == 1 and {r.group_size for r in out} == {50}
    assert exact_dedup.kept(docs.union(docs)).count() == len(set(texts))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4), st.integers(0, 99)), max_size=12), max_size=7))
def test_merge_of_runs_equals_a_sort_of_all(runs):
    digest = lambda k: np.frombuffer(hashlib.sha256(bytes([k])).digest(), ">u8").astype(np.uint64)
    entry = lambda run: (np.array([digest(k) for k, _, _ in run], np.uint64).reshape(-1, 4), np.array([i for _, i, _ in run], np.int64), np.array([r for _, _, r in run], np.int64), np.ones(len(run), np.int64))
    words, ids, rows, counts = exact_dedup.merged([exact_dedup._sorted_run(*entry(r)) for r in runs])
    every = [x for r in runs for x in r]
    want = sorted((digest(k).tolist(), min((i, r) for q, i, r in every if q == k), sum(q == k for q, _, _ in every)) for k in {k for k, _, _ in every})
    assert [(w, (i, r), n) for w, i, r, n in zip(words.tolist(), ids.tolist(), rows.tolist(), counts.tolist(), strict=True)] == want


def test_exact_dedup_ignores_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a  b", "x"), (2, "a b", "y"), (None, "c", "z")], "doc_id long, text string, text_sha256 string").withColumns({"digest": F.lit(1), "row": F.lit(2), "keep_id": F.lit(3)})
    out = exact_dedup.kept(docs)
    assert out.columns == docs.columns and sorted(r.text_sha256 for r in out.collect()) == ["x", "z"]


def test_exact_dedup_over_many_rounds(spark):
    rows = spark.range(0, 3000, 1, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    got = exact_dedup.label(rows).select("keep_id", "group_size").distinct().collect()
    assert {(r.keep_id) for r in got} == set(range(7)) and sum(r.group_size for r in got) == 3000


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in token_files.write_and_read(docs, P.path("word_bpe_49k.json")).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write_and_read(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), 64).collect()
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(got[i], key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == 64 for p in pieces[1:])
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


MARKED = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n\n x", "<|endoftext |> <|ENDOFTEXT|> <|startoftext|>it's", "é <|endoftext|>  Å\u030a <|endoftext", "plain"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "|>", " ", "  ", "\n", "it's", "a", "É", "12"]), max_size=12).map("".join), max_size=4))
def test_encoders_map_added_tokens_as_the_library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    encoder = (token_files.word_encoder if name.startswith("word") else packing.piece_encoder)(P.path(name))
    for text, raw in zip([*MARKED, *texts], encoder.encode([*MARKED, *texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=8))
def test_local_search_never_needs_more_bins(lengths):
    first = packing.best_fit(lengths, 20)
    last = packing.local_search(first, 20)
    assert sum(last.values()) <= sum(first.values())
    held = {}
    for c, n in last.items():
        assert sum(c) <= 20
        for s in c:
            held[s] = held.get(s, 0) + n
    assert held == lengths


def test_local_search_trades():
    from collections import Counter

    bins = Counter({(6, 3): 1, (5, 4): 1, (2,): 1})  # one exchange makes room for the two
    assert sum(packing.local_search(bins, 10).values()) == 2


def trade_left(bins, size):
    """Any two bins below capacity and a move or exchange that makes the fuller one fuller."""
    loose = [c for c, n in bins.items() if sum(c) < size]
    for giver in loose:
        for taker in loose:
            if sum(taker) < sum(giver) or (taker == giver and bins[giver] < 2):
                continue
            one, back = set(giver), {0, *taker}
            two = {u + v for i, u in enumerate(giver) for v in giver[i + 1 :]}
            both = {q + r for i, q in enumerate(taker) for r in taker[i + 1 :]}
            free = size - sum(taker)
            if any(0 < v - r <= free for v in one for r in back | both) or any(0 < v - r <= free for v in two for r in taker):
                return giver, taker
    return None


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=14))
def test_local_search_ends_when_no_trade_is_left(lengths):
    bins = packing.local_search(packing.best_fit(lengths, 40), 40)
    assert sum(bins.values()) == -(-sum(k * n for k, n in lengths.items()) // 40) or not trade_left(bins, 40)


def test_local_search_of_many_lengths():
    from collections import Counter

    lengths = Counter(np.random.default_rng(0).normal(260, 40, 5000).astype(int).tolist())
    first = packing.best_fit(lengths, 1024)
    last = packing.local_search(first, 1024)
    assert sum(first.values()) - sum(last.values()) > 30 and not trade_left(last, 1024)
    assert Counter(s for c, n in last.items() for s in c for _ in range(n)) == lengths


def test_token_shards_cut_by_bytes_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "b"), (None, "a " * 500), (3, "x"), (3, "w"), (1, None), (2, "long " * 3000), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shards = token_files.write(docs, P.path("word_bpe_49k.json"), f"{tmp_path}/d", shard_bytes=64)
    got = sorted(token_files.read(spark, f"{tmp_path}/d").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 3, 9] and len(shards) >= 3
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert sum(s["n_docs"] for s in shards) == len(rows) and not [p for p in (tmp_path / "d").iterdir() if p.name.endswith(".tmp")]


def test_decoding_by_offsets(spark):
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"))
    text = "Grüße, the cat's toy – 東京 123\n\n" * 20
    ids = np.frombuffer(c.encode([text])[0], "<u4")
    at = c.offsets(ids)
    assert c.decode(ids, at) == text.encode() and len(at) == len(ids)
    for first, end in ((0, 5), (7, 7), (13, 200), (100, 10_000)):
        assert c.decode_bytes(ids, at, first, end) == text.encode()[first:end]


def test_long_texts_are_cut_where_pieces_end(tik):
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "it's", " 12", "\u3000", "\x1c", "é", "!"], 4000))
    for most in (1, 7, 100):
        parts = [p for portion in bpe.portions([text, "", text[:50]], most) for p in portion]
        assert "".join(t for i, t in parts if i == 0) == text and max(map(len, (t for _, t in parts))) < 400 + most
        assert [x for i, t in parts if i == 0 for x in tik.encode_ordinary(t)] == tik.encode_ordinary(text)


def test_warc_offsets_repeats_and_streams(spark, tmp_path):
    big = "<p>" + "x" * 3000
    pages = [(1, "a", big), (1, "a", big), (2, "b", big), (2, "c", big), (None, "d", big), (None, "e", big), (3, "f", "é" * 200_000), (4, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    archives = warc.write(warc.roles(df), f"{tmp_path}/w")
    got = warc.read(archives).collect()
    assert sorted((r.page_id or 0, r.url, r.record_type, r.refers_to or 0) for r in got) == [(0, "d", "response", 0), (0, "e", "response", 0), (1, "a", "revisit", 2), (1, "a", "revisit", 2), (2, "b", "response", 0), (2, "c", "response", 0), (3, "f", "response", 0), (4, "", "response", 0)]
    import struct

    for r in archives.collect():
        raw, index = open(r.path, "rb").read(), open(f"{r.path}.idx", "rb").read()
        offsets = list(struct.unpack(f"<{len(index) // 8}q", index))
        whole = list(warc.records_of(raw, offsets))
        assert list(warc.records_of(raw)) == whole and len(whole) == r.n_records
        assert [warc.read_record(r.path, at) for at in offsets] == list(map(warc.parse, whole))


def test_warc(spark):
    same = "<p>" + "é" * 700
    pages = [(1, "http://a", same), (2, "http://b", None), (3, None, same), (4, "u\r\nv", "small"), (5, "w", "small"), (None, "n", same), (-6, "m", "x" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    got = {r.page_id: r for r in warc.write_and_read(df).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("response", None), -6: ("response", None)}
    assert warc.write_and_read(df.limit(0)).count() == 0


def brute_suffix(texts):
    seen, out = {}, []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], i) < i:
                cover[p] += 1
                cover[p + 50] -= 1
        out.append(np.cumsum(cover)[:-1] > 0)
    return out


def test_suffix_dedup(spark):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefghé "), 200))
    other = "".join(rng.choice(list("abcdefgh "), 300))
    texts = [passage, other + passage[:60] + "x" * 80, "y" * 70, passage[100:] + other[30:140], None, "", passage, passage[20:69], "zz" + passage[20:70] + "x" * 60, "x" * 49, other]
    texts += ["".join(rng.choice(list("abcdefgh "), 100)) + (passage[k : k + 55]) for k in range(40)]
    got = {r.doc_id: r for r in suffix_dedup.label(table(spark, texts)).collect()}
    for i, (t, gone) in enumerate(zip(texts, brute_suffix(texts), strict=True)):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw), gone.sum(), runs), i
        assert got[i].kept_sha256 == hashlib.sha256(raw[~gone].tobytes()).hexdigest()
    assert suffix_dedup.label(table(spark, texts).limit(0)).count() == 0
    cut = suffix_dedup.cut(table(spark, texts))
    assert cut.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and cut.count() == len(texts)


@pytest.mark.parametrize("lookup", [0, suffix_dedup.LOOKUP])
def test_suffix_dedup_with_hot_minimizers(spark, monkeypatch, lookup):
    monkeypatch.setattr(suffix_dedup, "LOOKUP", lookup)
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    phrase, passage = word(46), word(90)
    texts = [word(60) + (phrase if k % 2 else passage) + word(60) for k in range(60)] + [None, "", passage, word(300)]
    df = table(spark, texts).select("doc_id", "text")
    packed = {r.doc_id: r.vals for r in suffix_dedup.removals(df, hot_texts=20).collect()}
    for i, gone in enumerate(brute_suffix(texts)):
        cut = np.zeros(len(gone), bool)
        for a, b in suffix_dedup.united(packed[i]) if packed[i] else ():
            cut[a:b] = True
        assert (cut == gone).all() or texts[i] == passage, i
    assert len(suffix_dedup._hot_minimizers(df.where("text IS NOT NULL"), 20)) > 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=50, max_size=75), min_size=1, max_size=12))
def test_merged_transforms_find_every_repeat(strings):
    shards = [np.frombuffer(b"".join(bytes(x + 1 for x in s.encode()) + b"\0" for s in part), np.uint8) for part in (strings[::2], strings[1::2]) if part]
    text = np.concatenate(shards)
    where, interval = suffix_dedup.repeated(shards)
    found = {}
    for p, k in zip(where.tolist(), interval.tolist(), strict=True):
        found.setdefault(k, set()).add(p)
    want = {}
    for p in range(len(text) - 49):
        w = text[p : p + 50].tobytes()
        if 0 not in w:
            want.setdefault(w, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=75), min_size=1, max_size=12))
def test_places_of_a_shard_are_in_order_of_fifty_symbols(strings):
    text = np.frombuffer(b"".join(bytes(x + 1 for x in s.encode()) + b"\0" for s in strings), np.uint8)
    place = suffix_dedup._sorted_places(text)
    padded = text.tobytes() + bytes(50)
    keys = [padded[p : p + 50] for p in place.tolist()]
    assert sorted(place.tolist()) == list(range(len(text))) and keys == sorted(keys)


def test_marking_a_bucket_takes_memory_for_a_block():
    import tracemalloc

    rng = np.random.default_rng(5)
    kinds = [rng.integers(97, 123, n, np.uint8).tobytes() for n in rng.integers(50, 81, 40_000)]
    pick = np.concatenate([np.arange(len(kinds)), rng.integers(0, len(kinds), 20_000)])
    strings = [kinds[k] for k in pick]
    sizes, ids = np.array([len(x) for x in strings], np.uint8), rng.integers(0, 10_000, len(strings))
    rows, parts = np.arange(len(strings)), (pick * 2654435761 % 256).astype(np.uint8)
    tracemalloc.start()
    found = suffix_dedup._marked_by_block(np.frombuffer(b"".join(strings), np.uint8), sizes, rows, ids, np.zeros(len(strings), np.int64), parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    least = {}
    for x, i in zip(strings, ids.tolist(), strict=True):
        least[x] = min(least.get(x, i), i)
    want = {(k, 0, len(x)) for k, (x, i) in enumerate(zip(strings, ids.tolist(), strict=True)) if least[x] < i}
    assert set(zip(*[x.tolist() for x in found], strict=True)) == want
    assert peak < 64e6, peak  # 4 MB of strings; as one piece the bucket took 265 MB


def test_many_hot_windows_are_all_cut(spark):
    rng = np.random.default_rng(6)
    data, n = rng.integers(97, 123, 80 * 2_000, np.uint8), 2_000
    packed = [bytearray(x.tobytes()) for x in (data, np.full(n, 80, np.uint8), np.arange(n), np.arange(n) + 5, np.arange(n) * 100)]
    out = suffix_dedup._hot_windows(spark.createDataFrame([packed], "data binary, sizes binary, rows binary, ids binary, starts binary")).collect()
    got = {(r.row, r.id, r.start, bytes(r.window)) for r in out}
    assert got == {(k, k + 5, 100 * k + j, data[80 * k + j : 80 * k + j + 50].tobytes()) for k in range(n) for j in range(31)}


@pytest.mark.parametrize("lookup", [0, suffix_dedup.LOOKUP])
def test_equal_hot_strings_are_cut_into_windows_once(spark, monkeypatch, lookup):
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefghé "), n))
    passage, made, cut = word(400), [], suffix_dedup._hot_windows
    monkeypatch.setattr(suffix_dedup, "LOOKUP", lookup)
    monkeypatch.setattr(suffix_dedup, "_hot_windows", lambda *a: made.append(cut(*a)) or made[-1])
    texts = [word(30) + passage + word(30) + (passage[50:120] if k % 3 else "") for k in range(90)]
    ids = [None if k == 7 else k - 20 for k in range(90)]  # the text without an id is the last of all
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    packed = {r.doc_id: r.vals for r in suffix_dedup.removals(df, hot_texts=20).collect()}
    order = [k for k in range(90) if k != 7] + [7]
    for k, gone in zip(order, brute_suffix([texts[k] for k in order]), strict=True):
        marks = np.zeros(len(gone), bool)
        for a, b in suffix_dedup.united(packed[ids[k]]) if packed[ids[k]] else ():
            marks[a:b] = True
        assert (marks == gone).all(), k
    hot, strings = suffix_dedup._hot_minimizers(df, 20), []
    for parts in suffix_dedup.segments([t.encode() for t in texts]):
        raw, _, first, last, h = suffix_dedup.window_runs(parts)
        strings += [raw[a : b + 50] for a, b, x in zip(first.tolist(), last.tolist(), h.tolist(), strict=True) if x in set(hot.tolist())]
    once, every = (sum(len(x) - 49 for x in y) for y in (set(strings), strings))
    assert sum(m.count() for m in made) == once < every / 4, (once, every)


def test_quality_rules(spark, docs):
    import duckdb

    rows = [(i, t) for i, t in enumerate([*TEXTS, "the and of " * 12, "one two three four five six seven eight nine the of and to in is it for as on are", "- a\n- a\n* b..."])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    out = quality_rules.measure(df)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({quality_rules.sql()}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == want
    assert quality_rules.measure(docs.limit(0)).count() == 0
    assert quality_rules.passing(docs).columns == docs.columns


def test_near_dedup(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    base = [list(rng.choice(words, 120)) for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for k in range(10):
        near = list(base[k])
        near[60] = "changed"
        texts += [" ".join(near), " ".join(base[k]).upper()]
    texts += [None, "", "two words", "Two  words"]
    df = table(spark, texts)
    got = {r.doc_id: r for r in near_dedup.label(df).collect()}
    for k in range(10):
        assert got[30 + 2 * k].class_id == got[31 + 2 * k].class_id == got[k].class_id == k
        assert got[k].kept and not got[30 + 2 * k].kept and got[k].class_size == 3
    assert all(got[k].class_size == 1 for k in range(10, 30))
    assert got[51].class_id == 50 and got[53].class_id == 52
    assert near_dedup.label(df.limit(0)).count() == 0
    assert near_dedup.kept(df).count() == 32


def test_near_dedup_keeps_one_row_of_each_class_under_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(5000)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, t) for k, t in enumerate(base)]
    rows += [(None, base[0] + " tail"), (None, base[0].upper()), (5, base[1] + " tail"), (7, base[3]), (5, base[1])]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = near_dedup.kept(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == 12 and set(got) <= set(rows)
    of = lambda text: next(k for k, b in enumerate(base) if text.lower().startswith(b))
    assert sorted(of(t) for _, t in got) == list(range(12))
    assert (7, base[3]) in got and all((i, base[k]) in got for k, (i, _) in enumerate(rows[:12]) if k not in (0, 1, 3))
    labels = near_dedup.label(df).collect()
    assert len(labels) == len(rows) and sum(r.kept for r in labels) == 12


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    value = np.sort(rng.integers(1, 1 << 63, 3000, np.uint64))
    hits = []
    for shift in (300, 600):
        a, b = value[:1500], value[shift : 1500 + shift]
        codes = near_dedup.samples(np.repeat([0, 1], 1500), np.concatenate([a, b]), np.ones(3000), 2)
        hits.append(((codes[0] == codes[1]).mean(), (1500 - shift) / (1500 + shift)))
    assert all(abs(x - y) < 0.2 for x, y in hits)


def test_samples_agree_as_often_as_weighted_similarity_says():
    rng = np.random.default_rng(8)
    off = []
    for _ in range(30):
        value = np.sort(rng.integers(1, 1 << 63, 400, np.uint64))
        weight = rng.gamma(0.5, 3.0, 400) + 0.05
        scaled = weight * rng.choice([0.5, 1.0, 2.0], 400)
        both = near_dedup.samples(np.repeat([0, 1], 400), np.concatenate([value, value]), np.concatenate([weight, scaled]), 2)
        off.append((both[0] == both[1]).mean() - np.minimum(weight, scaled).sum() / np.maximum(weight, scaled).sum())
    assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.12


def plain_samples(doc, value, weight, n):
    """Every draw of every shingle worked out."""
    odd = np.random.default_rng(7).integers(1, 1 << 63, near_dedup.BANDS * near_dedup.ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    r, ln_c, beta = near_dedup._draws()
    out = np.zeros((n, len(odd)), np.uint32)
    for i in np.unique(doc):
        v, w = value[doc == i], np.log(weight[doc == i]).astype(np.float32)
        pick = ((v[:, None] * odd) >> np.uint64(48)).astype(np.int64)
        t = np.floor(w[:, None] / r[pick] + beta[pick])
        ln_a = ln_c[pick] - r[pick] * (t - beta[pick] + np.float32(1))
        own = (v >> np.uint64(8)).astype(np.uint32)[:, None] ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        least = ln_a == ln_a.min(axis=0)
        out[i] = np.where(least, own, np.uint32(2**32 - 1)).min(axis=0)
    return out


def bag(rng, texts, size):
    weight = rng.uniform(1 - near_dedup.DAMP, 1, texts * size)
    weight[::97], weight[1::89], weight[2::83] = 1.0, 1 - near_dedup.DAMP, 2.5
    return np.repeat(np.arange(texts), size), rng.integers(1, 1 << 63, texts * size, np.uint64), weight


def test_known_draws_give_what_working_out_gives():
    rng = np.random.default_rng(21)
    doc, value, weight = bag(rng, 40, 211)
    edges = np.exp(near_dedup._known_draws()[0].astype(float))
    weight[: 3 * len(edges)] = np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, 9)])
    assert (near_dedup.samples(doc * 2, value, weight, 80) == plain_samples(doc * 2, value, weight, 80)).all()


def test_most_draws_are_not_worked_out(monkeypatch):
    doc, value, weight = bag(np.random.default_rng(22), 50, 400)
    near_dedup._known_draws()
    drawn, floor = [], np.floor
    monkeypatch.setattr(near_dedup.np, "floor", lambda x: drawn.append(np.size(x)) or floor(x))
    near_dedup.samples(doc, value, weight, 50)
    assert sum(drawn) < len(value) * near_dedup.BANDS * near_dedup.ROWS / 20


def weighted_links(texts):
    """All pairs at the threshold, by brute force over all pairs and without hashing."""
    from collections import Counter
    from math import log1p

    bags = []
    for t in texts:
        w = (t or "").lower().split()
        bags.append(Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    df, n = Counter(s for b in bags for s in b), len(texts)
    weight = {s: 1 - near_dedup.DAMP + near_dedup.DAMP * log1p(n / k) / log1p(n) for s, k in df.items()}
    out = set()
    for i, a in enumerate(bags):
        for j in range(i):
            low = sum(min(a[s], bags[j][s]) * weight[s] for s in a.keys() & bags[j].keys())
            high = sum(max(a[s], bags[j][s]) * weight[s] for s in a.keys() | bags[j].keys())
            if not high or low / high >= near_dedup.THRESHOLD:
                out.add((j, i))
    return out


def test_near_dedup_equals_brute_force_over_all_pairs(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    texts = [None, "", "one two", "one  TWO"]
    for _ in range(12):  # families of copies with one to ten words changed, from clear copies to clear strangers, and repeated stretches
        base = list(rng.choice(words, 90)) + ["the same five words again"] * int(rng.integers(0, 4))
        for _ in range(8):
            own = list(base)
            for k in rng.choice(len(own), int(rng.integers(0, 6)), replace=False):
                own[k] = str(rng.choice(words))
            texts.append(" ".join(own))
    links = weighted_links(texts)
    label = list(range(len(texts)))
    for j, i in sorted(links):
        a, b = label[j], label[i]
        label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.class_id for r in near_dedup.label(table(spark, texts)).collect()}
    assert 40 < len(links) < 400
    assert np.mean([got[j] == got[i] for j, i in links]) >= 0.98  # recall of links
    assert all(label[i] == label[c] for i, c in got.items())  # no class joins what no chain of links joins


def test_licenses(spark):
    notice = dict(licenses.TEMPLATES[::-1])
    texts = ["Some words. Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 3.0.", "we licensed the photograph under no terms at all", None, "", "x " * 5000 + "Released under the MIT License. And Licensed under CC BY-SA 4.0.", notice["BSD-3-Clause"]]
    got = sorted((r.doc_id, r.license) for r in licenses.notices(table(spark, texts)).collect())
    assert got == [(0, "Apache-2.0"), (1, "CC-BY-NC-4.0"), (2, "CC-BY-4.0"), (7, "CC-BY-SA-4.0"), (7, "MIT"), (8, "BSD-3-Clause")]
    for r in licenses.notices(table(spark, texts)).where("doc_id = 7 AND license = 'MIT'").collect():
        assert texts[7][r.start : r.end] == "Released under the MIT License"
    assert licenses.notices(table(spark, texts).limit(0)).count() == 0


def test_each_license_template_alone_is_found(spark):
    texts = [t for _, t in licenses.TEMPLATES] + ["released into the public\n  domain. " + "x " * 60 + licenses.TEMPLATES[-1][1].replace("public domain", "public\ndomain")]
    got = sorted((r.doc_id, r.license) for r in licenses.notices(table(spark, texts)).collect())
    assert got == [*((i, k) for i, (k, _) in enumerate(licenses.TEMPLATES)), (len(licenses.TEMPLATES), "Unlicense")]


def test_no_license_is_lost_beside_an_unlisted_version():
    others = ["This work is licensed under the GNU General Public License, version 1. The bundled fonts are ", "Licensed under CC BY-NC-SA 3.0, licensed under CC BY-NC-ND 3.0; the rest of this is "]
    for other in others:
        for name, notice in licenses.TEMPLATES:
            assert [x[0] for x in licenses.scan(other + notice)] == [name]
            assert [x[0] for x in licenses.scan(notice + " " + other)] == [name]


def test_license_family_and_later_versions():
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License{} and so on"
    for kind, version, name in (("", 2, "GPL-2.0"), ("", 3, "GPL-3.0"), ("Lesser ", 2.1, "LGPL-2.1"), ("Lesser ", 3, "LGPL-3.0"), ("Affero ", 3, "AGPL-3.0")):
        for tail, end in ((".", ""), (", or (at your option) any later version.", "-or-later"), (" or later.", "-or-later"), (". Or later versions of it", "")):
            text = gnu.format(kind, version, tail)
            found = licenses.scan(text)
            assert [(x[0], x[3]) for x in found] == [(name + end, 0)]
            assert not end or text[: found[0][2]].endswith(("later version", "or later"))
    assert [x[0] for x in licenses.scan("This work is licensed under the GNU Lesser General Public License, version 3 or any later version.")] == ["LGPL-3.0-or-later"]
    assert [x[0] for x in licenses.scan("Released under the MIT License, or later under terms to be named.")] == ["MIT"]


def brute_wording(template, block):
    """The least differences over all spans and all alignments of the template's words with the span's."""
    from functools import cache

    best = None
    for i in range(len(block)):
        for j in range(i + 1, len(block) + 1):

            @cache
            def ways(k, p):
                if k == len(template):
                    return 0
                skip = 99 if any(c.isdigit() for c in template[k]) else 1 + ways(k + 1, p)
                return min([skip, *(ways(k + 1, q + 1) for q in range(p, j) if block[q] == template[k])])

            missing = ways(0, i)
            d = max(missing, j - i - (len(template) - missing))
            if d <= int(licenses.TOLERANCE * len(template)):
                best = d if best is None else min(best, d)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", "v2"]), min_size=10, max_size=21), st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["a", "the", "v2", ""])), max_size=4), st.lists(st.sampled_from(["a", "the", "x"]), max_size=4))
def test_wording_equals_brute_alignment(template, edits, around):
    block = list(template)
    for at, word in edits:
        block[at % len(block) : at % len(block) + (not word)] = [word] if word else []
    block = around + block + around[::-1]
    got = licenses.wording(template, block)
    assert (got and got[2]) == brute_wording(template, block)


def test_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in classifier.classify(docs).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i] == bool(q) for i, q in labels.items()]) > 0.93  # labels take no part in the training
    assert classifier.classify(table(spark, TEXTS)).count() == len(TEXTS)
    assert classifier.classify(table(spark, TEXTS).limit(0)).count() == 0


def test_scratch_is_the_shared_folder(spark):
    assert scratch(spark, "x").startswith(scratch_root(spark).rstrip("/"))

"""WARC archives with one Zstandard dictionary a file.

An archive begins with a skippable frame that holds a Zstandard dictionary; each record follows in a frame of its own,
compressed with that dictionary, so that any record can be read by its offset; the offsets stand in an index file beside the archive. The
dictionary is built from the archive's own records: those of one file are held (``ARCHIVE_BYTES`` at most, or one longer record) and every k-th of them is a sample.

A payload of at least ``MIN_REVISIT`` bytes that several pages share is stored once, with the largest page id, as a response; the
others become revisit records that name it and hold no payload, only its length and digest. Who revisits whom is found from ids, lengths and digests
alone; payloads are shuffled once, by page id, so a payload that many pages share is never gathered.

Defined cases: a null payload counts as empty; a null page id is stored as a response and never referred to; of rows with equal
id and payload each gets a record, all of them responses if theirs is the largest id; null urls are written as empty; an
empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, open_fs, put_file, scratch, ship, spread_join, staged

#: The skippable frame's magic number, and the revisit profile of WARC 1.1.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
#: Bytes fed to the decompressor at a time where the end of a frame is not known.
FRAME_BLOCK = 64 << 10
DATE = "2000-01-01T00:00:00Z"


def record_id(page: int | None, salt: str = "") -> str:
    """A version 8 UUID that holds the page id; a random one for a page without id."""
    if page is None:
        return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, salt)}"
    n = page & (1 << 64) - 1
    return f"urn:uuid:{uuid.UUID(int=((n >> 48) << 80) | (8 << 76) | (2 << 62) | (n & (1 << 48) - 1))}"


def page_of(name: str) -> int:
    n = uuid.UUID(name).int
    n = ((n >> 80) & 0xFFFF) << 48 | n & (1 << 48) - 1
    return n - (1 << 64) if n >> 63 else n


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, whose payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id(page, clean + digest)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(refers_to)}>")]
    if page is not None:
        head.append(("Page-ID", str(page)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields in lower case, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:n]


def dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from evenly spaced records; raw content where there are too few to train on."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(x[:4096] for x in samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def archive(records: list[bytes]) -> tuple[list[bytes], list[int]]:
    """(parts of the file, offset of each record)."""
    import zstandard

    raw = dictionary(records)
    engine = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    parts, offsets = [struct.pack("<II", SKIPPABLE, len(raw)) + raw], []
    at = len(parts[0])
    for x in records:
        parts.append(engine.compress(x))
        offsets.append(at)
        at += len(parts[-1])
    return parts, offsets


def records_of(raw: bytes, offsets: list[int] | None = None):
    """The records of an archive, in order; without an index the ends of frames are found by reading them, a block at a time."""
    import zstandard

    magic, n = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n]))
    view = memoryview(raw)
    if offsets is not None:
        for a, b in zip(offsets, [*offsets[1:], len(raw)], strict=True):
            yield engine.decompressobj().decompress(view[a:b])
        return
    at = 8 + n
    while at < len(raw):
        one, text = engine.decompressobj(), []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("an archive ends within a record")
            block = view[at : at + FRAME_BLOCK]
            text.append(one.decompress(block))
            at += len(block)
        at -= len(one.unused_data)
        yield b"".join(text)


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: response)."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    same = F.concat_ws(":", "digest", F.octet_length("payload"))
    keys = staged(rows.where((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", same.alias("same")), "keys")
    shared = staged(keys.groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "shared")
    copies = keys.join(shared.select("same"), "same", "left_semi")
    later = spread_join(copies, shared, "same", "n").where("page_id < last").select(F.col("page_id").alias("of"), "same", "last").distinct()
    # pages without an id are dealt by their digest; none of them is a revisit
    own = rows.withColumn("same", same).withColumn("of", F.coalesce("page_id", F.xxhash64("url", "digest")))
    joined = own.join(later, ["of", "same"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNotNull(), F.col("last")).alias("refers_to"))


def write(rows: DataFrame, out: str) -> DataFrame:
    """Write the archives of ``roles`` rows below ``out``, each with an index of 64-bit offsets; one row per archive: path, n_records; staged."""
    ship(rows.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        p, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal part, held, size
            parts, offsets = archive(held)
            path = f"{out}/archive-{p:06d}-{part:04d}.warc.zst"
            put_file(path, *parts)
            put_file(f"{path}.idx", struct.pack(f"<{len(offsets)}q", *offsets))
            made = pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)]})
            part, held, size = part + 1, [], 0
            return made

        for batch in batches:
            for page, url, payload, digest, to in zip(*[batch[k] for k in ("page_id", "url", "payload", "digest", "refers_to")], strict=True):
                held.append(record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), to.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return staged(rows.mapInArrow(lean(run, 64), "path string, n_records long"), "archives")


def read_record(path: str, offset: int) -> tuple[dict[str, str], bytes]:
    """The record whose frame begins at ``offset`` of an archive; only the dictionary and this frame are read."""
    import zstandard

    files, at = open_fs(path)
    with files.open_input_file(at) as f:
        _, n = struct.unpack("<II", f.read(8))
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(n))).decompressobj()
        f.seek(offset)
        text = []
        while not one.eof:
            block = f.read(FRAME_BLOCK)
            if not block:
                raise ValueError("an archive ends within a record")
            text.append(one.decompress(block))
    return parse(b"".join(text))


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive."""
    ship(archives.sparkSession)
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"

    def one(raw: bytes, path: str):
        fields, block = parse(raw)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{path}: a payload differs from its digest")
        page = fields.get("page-id")
        to = fields.get("warc-refers-to")
        return page and int(page), fields["warc-target-uri"], size, digest, kind, to and page_of(to.strip("<>")), path.rpartition("/")[2]

    def run(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                files, at = open_fs(path)
                with files.open_input_file(at) as f:
                    raw = f.read()
                with files.open_input_file(f"{at}.idx") as f:
                    index = f.read()
                rows = [one(x, path) for x in records_of(raw, list(struct.unpack(f"<{len(index) // 8}q", index)))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(k, pa.string() if k in ("url", "payload_digest", "record_type", "archive") else pa.int64()) for k in names]))

    spark = archives.sparkSession
    return archives.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(lean(run, 1), schema)


def write_and_read(pages: DataFrame) -> DataFrame:
    return read(write(roles(pages), scratch(pages.sparkSession, "warc")))


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN last END AS refers_to FROM m"""

"""Shared pieces of the training-data operators: the scratch folder, staged tables, package shipping."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and text contracts, as a character list and as a Java/RE2 pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

_own: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and all tasks run in this process (tests on one machine) is
    a local folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext.getCheckpointDir()
        if made:
            return made
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hedgerow-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext.getCheckpointDir()
    return root


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; ``release`` or the end of the driver removes it."""
    path = f"{scratch_root(spark).rstrip('/')}/hedgerow-{tag}-{uuid.uuid4().hex}"
    _own.append((spark, path))
    return path


#: Spark's own setting: the shuffle files of a query go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors; its shuffle files go at once."""
    spark = df.sparkSession
    path, was = scratch(spark, tag), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str | None = None) -> None:
    """Delete one scratch path, or all of this driver's."""
    for pair in [x for x in _own if path is None or x[1] == path]:
        _own.remove(pair)
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(pair[1])
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone already; leftovers are only scratch files
            return


@atexit.register
def _at_exit() -> None:
    if _own:
        release(_own[0][0])


#: A key with more than one in ``HOT`` of the rows is hot, so there are fewer than ``HOT`` of them, and a row of each can be broadcast.
HOT = 1000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with what ``groups`` (staged; a row for each key, ``size``: how many rows share it) says of their key; every key has its group.

    Hot keys' rows stay where they are and meet their group by broadcast, fewer than ``HOT`` rows whatever the corpus. The others
    meet by shuffle, where no task gets more than a small share.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(size) * HOT > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups, key)
    return rows.join(hot, key).unionByName(rest)


def ship(spark: SparkSession) -> None:
    """Give executors this package where their PYTHONPATH lacks it."""
    top = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    at = Path(tempfile.mkdtemp(prefix="hedgerow-zip-")) / "hedgerow.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in (top / "hedgerow").rglob("*.py"):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def open_fs(uri: str):
    """(file system, path) of a folder that tasks write to; any store that pyarrow opens, a mounted folder included."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, *parts) -> None:
    """Write a file in one go; see ``new_file``."""
    with new_file(uri) as out:
        for x in parts:
            out.write(x)


@contextlib.contextmanager
def new_file(uri: str):
    """A stream to a name of this attempt's own, renamed at the end: a lost or repeated task leaves one whole file."""
    files, path = open_fs(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with files.open_output_stream(own, compression=None) as out:
            yield out
    except BaseException:
        files.delete_file(own)
        raise
    files.move(own, path)


def chunks(texts: list[bytes], most: int = 1 << 20):
    """Cut a list of texts into index ranges of about ``most`` bytes; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def lean(run, rows: int = 512):
    """``run`` over batches of at most ``rows`` rows, giving freed memory back at the end.

    Workers live on between tasks, so what the allocators hold of a finished task would add up over the stages of a job.
    """

    def task(batches):
        try:
            yield from run(b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows))
        finally:
            trim()

    return task


def trim() -> None:
    """Give memory that is free back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)

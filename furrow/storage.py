"""Shared storage for results that iterations reread, and small files in any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on this machine alone gets a new local folder, and any other session an error: parts
    that executors write to their own disks would be lost without a word.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="furrow-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one. The file system deletes it when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over four tasks a core: for few rows, in one or two files, that each make many."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _reach(path: str | Path) -> tuple:
    """(file system, path) of Hadoop's, for any store that Spark reaches."""
    context = SparkSession.active().sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(str(path))
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def files_of(path: str | Path) -> list[tuple[str, int]]:
    """(uri, size) of a file, of a folder's files, or of those that a pattern matches; none is an error."""
    store, place = _reach(path)
    found = [f for s in store.globStatus(place) or [] for f in (store.listStatus(s.getPath()) if s.isDirectory() else [s])]
    files = [(f.getPath().toUri().toString(), f.getLen()) for f in found if f.isFile() and f.getPath().getName()[0] not in "._"]
    if not files:
        raise FileNotFoundError(str(path))
    return sorted(files)


def read_start(uri: str, size: int) -> bytes:
    """The first ``size`` bytes of a file, or all that it has."""
    store, place = _reach(uri)
    stream = store.open(place)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


@contextmanager
def writing(path: str | Path) -> Iterator[Callable[[bytes], None]]:
    """A function that appends to a new file, made with its folders: local, or where the path's scheme says."""
    if ":" not in str(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with Path(path).open("wb") as out:
            yield lambda data: out.write(data)
        return
    store, place = _reach(path)
    out = store.create(place, True)
    try:
        yield lambda data: out.write(bytearray(data))
    finally:
        out.close()


def write_bytes(path: str | Path, data: bytes) -> None:
    with writing(path) as write:
        for a in range(0, len(data), 1 << 22):
            write(data[a : a + (1 << 22)])

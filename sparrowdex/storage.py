"""Tables that cut lineage, kept where the driver and every executor can read them, and removed when the application ends."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders of applications that are already marked to be deleted at their end.
_marked: set[str] = set()
#: Places named within temporaries(), of one thread.
_named: ContextVar[list[str] | None] = ContextVar("_named", default=None)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package; on a cluster it is installed or given by ``--py-files``."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where none is set and all runs on this machine, as in tests."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sparrowdex-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the application's own folder there, which the file system deletes when the application ends."""
    own = f"{shared_dir(spark)}/sparrowdex/{spark.sparkContext.applicationId}"
    if own not in _marked:
        fs, p = _at(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    if (named := _named.get()) is not None:
        named.append(path)
    return path


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Within it, whatever shared_path names is deleted at the end, so what reads such tables must be computed before."""
    named: list[str] = []
    token = _named.set(named)
    try:
        yield
    finally:
        _named.reset(token)
        for path in named:
            drop_path(spark, path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and its path: later steps survive lost executors and never recompute it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_path named."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listing(spark: SparkSession, root: str) -> tuple[str, list[tuple[str, int]]]:
    """(root in full, (path in full, bytes) of all files below it), whatever they are named."""
    fs, p = _at(spark, root)
    full = fs.makeQualified(p)
    out, found = [], fs.listFiles(full, True)
    while found.hasNext():
        file = found.next()
        out.append((file.getPath().toString(), file.getLen()))
    return full.toString().rstrip("/"), sorted(out)


def version(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files of a table: it changes when the table does."""
    fs, p = _at(spark, path)
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        file = found.next()
        out.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    """path in full, with its scheme."""
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file such as a pointer or a sidecar, put in place by a rename."""
    fs, p = _at(spark, path)
    _, new = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(new, p):
        raise OSError(f"{path} cannot be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()

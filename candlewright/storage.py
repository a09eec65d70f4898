"""Where intermediate tables go: the folder that driver and executors share; and what goes on in it."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and everything runs in this process, one that goes
    with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="candlewright-")
            atexit.register(shutil.rmtree, _own[app], True)
        found = f"file://{_own[app]}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; purge() deletes it."""
    path = f"{shared_dir(spark)}/candlewright/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def purge(spark: SparkSession) -> None:
    """Deletes what fresh_path() has given out so far.  Results are lazy, so call it once they are stored."""
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str):
    """Settings (with _ for .) that hold inside; those before come back."""
    names = {k: k.replace("_", ".") for k in settings}
    before = {k: spark.conf.get(names[k], None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(names[k]) if v is None else spark.conf.set(names[k], v)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a file or folder in one step of the file system; whether it did: no if `old` is not there."""
    fs, p = _fs(spark, old)
    _, to = _fs(spark, new)
    if not fs.exists(p):
        return False
    fs.mkdirs(to.getParent())
    if fs.exists(to):
        raise ValueError(f"{new} is there already")
    return fs.rename(p, to)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole: written beside and renamed; whether this call made it."""
    fs, p = _fs(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}"
    _, q = _fs(spark, aside)
    out = fs.create(q, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if fs.exists(p) or not fs.rename(q, p):
        fs.delete(q, False)
        return False
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    return [name for name, _, _ in listed(spark, path)]


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(name, bytes, is a folder) of what lies in a folder, in order of names."""
    fs, p = _fs(spark, path)
    return sorted((x.getPath().getName(), x.getLen(), x.isDirectory()) for x in fs.listStatus(p)) if fs.exists(p) else []


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty where nothing was written."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)

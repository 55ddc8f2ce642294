"""Paths through Hadoop's file system API, so that any store Spark reaches will do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """name, is directory, bytes, time of change of what lies in a directory; sorted; empty if it is not there."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    found = [(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
    return sorted(x for x in found if x[0][0] not in "._")


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """full path, bytes, time of change of every file under a path, or of the file itself."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    found, walk = [], fs.listFiles(p, True)
    while walk.hasNext():
        s = walk.next()
        if s.getPath().getName()[0] not in "._":
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move; what was at the new place must be gone before."""
    fs, p = _at(spark, old)
    _, q = _at(spark, new)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"cannot rename {old} to {new}")


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """staged takes the place of path, if anything is there. The old one is put aside, not deleted, until the new
    one stands; where a crash left it aside alone, put_back() brings it back."""
    put_back(spark, path)
    old = aside(path)
    if exists(spark, path):
        rename(spark, path, old)
    rename(spark, staged, path)
    delete(spark, old)


def put_back(spark: SparkSession, path: str) -> None:
    """Undo or finish a swap that a crash cut short."""
    old = aside(path)
    if exists(spark, old):
        if exists(spark, path):
            delete(spark, old)
        else:
            rename(spark, old, path)


def aside(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/_aside-{name}"


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that nobody has written yet, whole or not at all; whether it was this one. As exclusive as the file
    system's rename to a path that must not exist."""
    fs, tmp = _at(spark, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
    _, p = _at(spark, path)
    stream = fs.create(tmp, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(p), options)
    except Py4JJavaError:
        fs.delete(tmp, False)
        if not fs.exists(p):
            raise
        return False
    return True


def uri(spark: SparkSession, path: str) -> str:
    """A path as Spark's _metadata.file_path gives it."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over: a reader sees the old text or the new one."""
    fs, tmp = _at(spark, f"{path}.tmp")
    _, p = _at(spark, path)
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(tmp), fs.makeQualified(p), options)

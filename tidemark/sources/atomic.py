"""Small files that appear whole or not at all, and the newest of a folder."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def publish(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file beside its place and move it there; raises FileExistsError if there is one, which then stays."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            # a local rename overwrites; a link does not
            at = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(at(target), at(part))
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, none)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from e
        raise
    finally:
        fs.delete(part, False)


def names(spark: SparkSession, folder: str, suffix: str = ".json") -> list[str]:
    """The names of the folder's files with a suffix, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in found if n.endswith(suffix) and not n.startswith("."))


def read(spark: SparkSession, path: str) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def newest(spark: SparkSession, folder: str) -> dict | None:
    """The JSON of the last file by name."""
    found = names(spark, folder)
    return json.loads(read(spark, f"{folder}/{found[-1]}")) if found else None

"""Versioned folders: a reader gets a whole version, the last one published.

A writer puts everything under a folder name of its own and then publishes that
name: a small file, written aside and renamed into ``_versions``, so it is
there whole or not at all. Readers take the file that sorts last. A writer that
dies before publishing leaves nothing that a reader sees. Files go through
Hadoop's file system, so any store that Spark writes to will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ridelens.session import remove_path

_LIST = "_versions"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def published(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, name) of every published version, the last at the end."""
    fs, where = _fs(spark, f"{folder}/{_LIST}")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted((int(n.split("~")[0]), n.split("~", 1)[1]) for n in names if n[:1].isdigit())


def new_version(prefix: str = "v") -> str:
    return f"{prefix}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, name: str) -> int:
    """Makes ``name`` (a folder under ``folder``, written by now) the last version; returns its number."""
    done = published(spark, folder)
    number = done[-1][0] + 1 if done else 1
    fs, aside = _fs(spark, f"{folder}/_publishing-{uuid.uuid4().hex}")
    fs.create(aside, False).close()
    fs.mkdirs(_fs(spark, f"{folder}/{_LIST}")[1])
    if not fs.rename(aside, _fs(spark, f"{folder}/{_LIST}/{number:010d}~{name}")[1]):
        raise RuntimeError(f"could not publish {name} in {folder}")
    return number


def latest(spark: SparkSession, folder: str) -> str | None:
    """The name of the last published version; None before the first."""
    done = published(spark, folder)
    return done[-1][1] if done else None


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Removes all but the ``keep`` last versions (readers may still hold the one before the last)."""
    old = published(spark, folder)[: -max(1, keep)]
    for number, name in old:
        remove_path(spark, f"{folder}/{_LIST}/{number:010d}~{name}")
        remove_path(spark, f"{folder}/{name}")
    return [name for _, name in old]


def input_stamp(spark: SparkSession, paths) -> str:
    """A digest of the names, sizes and times of all files under ``paths``: it changes when an input changes."""
    import hashlib

    found = []
    for path in paths:
        fs, where = _fs(spark, path)
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()

"""One small file that says which folders of a table are current.

A writer puts its data in new folders and then the next pointer, which is created whole or not at all. A write that
fails before leaves the table as it was; readers that began before go on with the folders they were given.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_PREFIX = "pointer-"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def pointer_version(spark: SparkSession, path: str) -> int:
    """Number of the current pointer, 0 where there is none."""
    target, system = _files(spark, path)
    if not system.exists(target):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(target)]
    return max([int(n[len(_PREFIX):]) for n in names if n.startswith(_PREFIX) and n[len(_PREFIX):].isdigit()], default=0)


def read_pointer(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What the current pointer says (or that of a version), None where there is none."""
    number = pointer_version(spark, path) if version is None else version
    if not number:
        return None
    rows = spark.read.text(f"{path}/{_PREFIX}{number:010d}", wholetext=True).collect()
    return {**json.loads(rows[0][0]), "version": number}


def write_pointer(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes ``content`` the pointer number ``version``. Another writer that was first is an error."""
    target, system = _files(spark, path)
    system.mkdirs(target)
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_PREFIX}{version:010d}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if system.exists(final) or not system.rename(draft, final):
        system.delete(draft, False)
        raise RuntimeError(f"{path} was written by another writer meanwhile; repeat the write")


def delete_folder(spark: SparkSession, path: str) -> None:
    target, system = _files(spark, path)
    system.delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    target, system = _files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()) if system.exists(target) else []

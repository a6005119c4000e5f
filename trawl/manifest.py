"""Manifests: small numbered files that name the folders which count.

Data is written to new folders first; the manifest that names them is put in place last, by a rename
to the next number. A reader takes the newest, so what it names changes in one step.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "manifests"


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    hadoop, system = _hadoop(spark, path)
    system.delete(hadoop, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands in a folder, none if there is no such folder."""
    hadoop, system = _hadoop(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(hadoop)) if system.exists(hadoop) else []


def _numbered(spark: SparkSession, path: str) -> list[str]:
    return [name for name in names(spark, f"{path}/{FOLDER}") if name.endswith(".json")]


def read_json(spark: SparkSession, file: str) -> dict:
    hadoop, system = _hadoop(spark, file)
    stream = system.open(hadoop)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, path: str) -> dict | None:
    """What the newest manifest of a folder says, None if it has none."""
    every = _numbered(spark, path)
    return read_json(spark, f"{path}/{FOLDER}/{every[-1]}") if every else None


def publish(spark: SparkSession, path: str, facts: dict) -> dict[str, dict]:
    """Make ``facts`` the newest manifest; gives the older ones by name, in order.

    It is written aside and renamed. Where another writer took the number first, nothing changes and
    the call fails.
    """
    every = _numbered(spark, path)
    number = 1 + int(every[-1].split(".")[0]) if every else 1
    aside, system = _hadoop(spark, f"{path}/{FOLDER}/.{uuid.uuid4().hex}")
    out = system.create(aside)
    out.write(bytearray(json.dumps(facts), "utf-8"))
    out.close()
    target, _ = _hadoop(spark, f"{path}/{FOLDER}/{number:08d}.json")
    if system.exists(target) or not system.rename(aside, target):
        raise RuntimeError(f"another writer of {path} came first")
    return {name: read_json(spark, f"{path}/{FOLDER}/{name}") for name in every}

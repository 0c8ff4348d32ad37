"""Versions of a stored table: numbered manifests that are created, never replaced, so a reader sees one whole version or the one before.

A writer puts data into folders of its own, then creates the next manifest, which names them. Nothing is deleted, renamed or
overwritten on the way. A writer that dies leaves data that no manifest names, or a manifest that ends too early, which
readers pass over. Of two writers of one number the second fails. The store must refuse to create a file that exists.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/{MANIFESTS}")
    return hadoop, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    _, folder, fs = _store(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """The manifest of a number, or None where it isn't there or isn't whole."""
    hadoop, folder, fs = _store(spark, path)
    name = hadoop.Path(folder, f"{number:010d}.json")
    if not fs.exists(name):
        return None
    stream = fs.open(name)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return None
    return found if isinstance(found, dict) and found.get("whole") else None


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest whole manifest; (0, {}) where there is none."""
    for number in reversed(_numbers(spark, path)):
        found = _manifest(spark, path, number)
        if found is not None:
            return number, found
    return 0, {}


def listed_buckets(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the ``bucket=n`` folders that a write has made."""
    hadoop, _, fs = _store(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(folder))]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def data_folder() -> str:
    """A new name for a folder of data, relative to the table's path."""
    return f"data-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, content: dict, based_on: int) -> int:
    """Make ``content`` the newest version if ``based_on`` still is; gives its number, or raises ``Conflict``."""
    hadoop, folder, fs = _store(spark, path)
    if latest(spark, path)[0] != based_on:
        raise Conflict(f"{path} has a newer version than {based_on}")
    # The number of a manifest that isn't whole is never used again.
    number = max([based_on, *_numbers(spark, path)]) + 1
    try:
        stream = fs.create(hadoop.Path(folder, f"{number:010d}.json"), False)
    except Exception as error:
        raise Conflict(f"another writer has begun version {number} of {path}") from error
    try:
        stream.write(bytearray(json.dumps(content | {"whole": True}).encode()))
    finally:
        stream.close()
    return number


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep`` whole ones, and the folders that only deleted ones name. Gives these folders.

    Folders that no manifest names stay, as a writer may be about to commit them. ``content["folders"]`` lists a manifest's folders.
    """
    hadoop, folder, fs = _store(spark, path)
    whole = [(n, m) for n in _numbers(spark, path) if (m := _manifest(spark, path, n)) is not None]
    kept = {f for _, m in whole[-keep:] for f in m.get("folders", [])}
    gone = sorted({f for _, m in whole[:-keep] for f in m.get("folders", [])} - kept)
    for name in gone:
        fs.delete(hadoop.Path(f"{path}/{name}"), True)
    for number, _ in whole[:-keep]:
        fs.delete(hadoop.Path(folder, f"{number:010d}.json"), False)
    return gone

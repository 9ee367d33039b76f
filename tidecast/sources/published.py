"""Versioned results: parts are written first, then a manifest publishes them together.

A version is a manifest that names the folder of every part (a segment, a month). Readers take the newest manifest and
read the folders it names, so they see whole versions only:

* a write that is cut off leaves folders that no manifest names; the version before stays readable;
* replacing some parts writes these alone and publishes a manifest that keeps the folders of all others;
* a manifest gets the next number, which must be free: of two writers the second fails and may try again. The number is
  looked up first; in the instant until the rename a second writer is kept out only by file systems that refuse a taken name;
* an old version stays readable by its number, until its folders are removed with ``forget``.

Manifests hold one line per part. Parts are the values of a partition column, whose number the registry bounds, not rows.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.sources.files import read_csv, write_csv

_MANIFEST = re.compile(r"manifest-(\d{8})\.json$")
#: Parts that a manifest lists at most; a column with more values is no partition column.
MOST_PARTS = 100_000


class StaleVersion(RuntimeError):
    """Another writer has published since the version that this write started from."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, in order."""
    system, folder = _files(spark, root)
    if not system.exists(folder):
        return []
    names = [str(status.getPath().getName()) for status in system.listStatus(folder)]
    return sorted(int(m[1]) for m in map(_MANIFEST.match, names) if m)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """Folder of every part of a version, by default of the newest one; empty if nothing is published."""
    known = versions(spark, root)
    if version is None:
        if not known:
            return {}
        version = known[-1]
    if version not in known:
        raise FileNotFoundError(f"{root} has no version {version}")
    system, path = _files(spark, f"{root}/manifest-{version:08d}.json")
    stream = system.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _publish(spark: SparkSession, root: str, version: int, parts: dict[str, str]) -> None:
    """Creates a manifest under a name that must be free. It is complete before it has that name."""
    text = json.dumps(parts, ensure_ascii=False, sort_keys=True, indent=0)
    system, waiting = _files(spark, f"{root}/_waiting-{uuid.uuid4().hex}")
    stream = system.create(waiting, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    _, final = _files(spark, f"{root}/manifest-{version:08d}.json")
    if system.exists(final) or not system.rename(waiting, final):
        system.delete(waiting, False)
        raise StaleVersion(f"version {version} of {root} has been published by another writer")


def write(rows: DataFrame, root: str, part: str, replace: bool = False, based_on: int | None = None) -> int:
    """Publishes ``rows`` as the next version and returns its number.

    With ``replace`` the parts that the rows hold are replaced and all others stay; otherwise the version
    holds these rows alone. ``based_on``: the version that the rows were made from, by default the newest; if another one
    has been published since, nothing is published. A part without a value is refused.
    """
    spark = rows.sparkSession
    known = versions(spark, root)
    base = (known[-1] if known else 0) if based_on is None else based_on
    folder = f"{root.rstrip('/')}/data-{uuid.uuid4().hex}"
    write_csv(rows, folder, [part])
    system, path = _files(spark, folder)
    written = {}
    for status in system.listStatus(path):
        name = str(status.getPath().getName())
        if status.isDirectory() and name.startswith(f"{part}="):
            written[name.partition("=")[2]] = f"{folder.rsplit('/', 1)[1]}/{name}"
    if "__HIVE_DEFAULT_PARTITION__" in written:
        raise ValueError(f"rows without a value of {part}")
    if len(written) > MOST_PARTS:
        raise ValueError(f"{part} has {len(written)} values")
    parts = (manifest(spark, root, base) if replace and base else {}) | written
    if versions(spark, root)[-1:] != ([base] if base else []):
        raise StaleVersion(f"{root} is no longer at version {base}")
    _publish(spark, root, base + 1, parts)
    return base + 1


def _decoded(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read(spark: SparkSession, root: str, schema: T.StructType, part: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest: headers and lines are checked against ``schema``.

    The part's column comes from the folder; its values are text.
    """
    parts = manifest(spark, root, version)
    if not parts:
        return spark.createDataFrame([], schema)
    inner = T.StructType([f for f in schema.fields if f.name != part])
    rows = read_csv(spark, [f"{root.rstrip('/')}/{folder}" for folder in parts.values()], inner)
    named = F.regexp_extract(F.col("_metadata.file_path"), f"/{re.escape(part)}=([^/]*)/[^/]*$", 1)
    # Once for the file's URI, once for the characters that a folder's name cannot hold.
    return rows.select("*", _decoded(_decoded(named)).alias(part)).select(*schema.names)


def forget(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Removes all versions but the newest ``keep`` and the folders of parts that none of the kept ones names.

    Folders of a write that is still under way are not named by any manifest: only parts that a removed version
    named go. Returns the removed numbers.
    """
    if keep < 1:
        raise ValueError("at least one version stays")
    known = versions(spark, root)
    gone, kept = known[:-keep], known[-keep:]
    needed = {folder for v in kept for folder in manifest(spark, root, v).values()}
    for version in gone:
        for folder in manifest(spark, root, version).values():
            if folder not in needed:
                system, path = _files(spark, f"{root}/{folder}")
                system.delete(path, True)
        system, path = _files(spark, f"{root}/manifest-{version:08d}.json")
        system.delete(path, False)
    return gone

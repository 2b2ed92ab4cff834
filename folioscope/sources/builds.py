"""What has changed since the last build: fingerprints of files and rows, and builds that compute only what is new.

A build keeps, under its path, one folder for each version and a pointer, a small file that names the current one. A version
holds the outputs and a manifest: for each key the digest of its inputs and of the recipe that made its output. A build
compares digests first, computes the rows whose digest is new, copies the others, and moves the pointer last; a build
that fails leaves the pointer as it was. If the files that the rows are read from are those of the last build, and the recipe
is, nothing is read at all.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_fingerprint(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that df reads, and of what it does with them."""
    spark, lines = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        at, fs = _fs(spark, name)
        status = fs.getFileStatus(at)
        lines.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    if not lines:  # rows that come from no file have no fingerprint of their own: never the same twice
        return uuid.uuid4().hex
    shape = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    return hashlib.sha256("\n".join([*lines, shape]).encode()).hexdigest()


def row_digest(columns: Sequence[str]):
    """A digest of a row's inputs; nulls differ from empty strings, and neighbours don't run into one another."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


class Refused(ValueError):
    """The new rows are not what a build should replace the old ones by."""


class Report(NamedTuple):
    version: str
    computed: int
    reused: int
    gone: int


def _read_pointer(spark: SparkSession, path: str) -> dict | None:
    at, fs = _fs(spark, f"{path}/current.json")
    if not fs.exists(at):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(at.toString()).collect()))


def _move_pointer(spark: SparkSession, path: str, held: dict) -> None:
    """Written beside and renamed over the old one: a reader sees the old or the new pointer. On a store whose renames are
    copies this is the copy of one small file."""
    draft, fs = _fs(spark, f"{path}/current-{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    final, _ = _fs(spark, f"{path}/current.json")
    if fs.exists(final):
        fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"could not move the pointer of {path}")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The outputs of the last build."""
    held = _read_pointer(spark, path)
    if held is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{held['version']}/outputs")


def build(rows: DataFrame, path: str, key: str, inputs: Sequence[str], recipe: str, compute: Callable[[DataFrame], DataFrame], most_gone: float = 0.1) -> Report:
    """Bring the outputs at path up to date with rows. compute: of rows, a DataFrame with their key and its outputs, one row
    for each. recipe: changes whenever compute does. Refuses rows with null or repeated keys, and rows that lack more
    than the share ``most_gone`` of the keys of the last build."""
    spark = rows.sparkSession
    files, held = file_fingerprint(rows), _read_pointer(spark, path)
    if held and held["files"] == files and held["recipe"] == recipe:
        return Report(held["version"], 0, held["rows"], 0)
    version = uuid.uuid4().hex
    at = f"{path}/{version}"
    rows.select(F.col(key).alias("key"), row_digest(inputs).alias("digest")).write.parquet(f"{at}/manifest")
    manifest = spark.read.parquet(f"{at}/manifest")
    total, keys = manifest.count(), manifest.filter("key is not null").select("key").distinct().count()
    if total != keys:
        raise Refused(f"{total - keys} rows without a key of their own")
    known = old = None
    if held:
        old = spark.read.parquet(f"{path}/{held['version']}/manifest")
        gone = old.join(manifest, "key", "left_anti").count()
        if gone > most_gone * held["rows"]:
            raise Refused(f"{gone} of {held['rows']} rows would go")
        if held["recipe"] == recipe:
            known = old.join(manifest, ["key", "digest"], "left_semi").select("key")
    else:
        gone = 0
    reused = known.count() if known is not None else 0
    new_keys = manifest.select("key") if known is None else manifest.select("key").join(known, "key", "left_anti")
    fresh = compute(rows.join(new_keys, rows[key] == new_keys["key"], "left_semi"))
    fresh.write.parquet(f"{at}/outputs")
    if reused:
        kept = spark.read.parquet(f"{path}/{held['version']}/outputs")
        kept.join(known, kept[key] == known["key"], "left_semi").write.mode("append").parquet(f"{at}/outputs")
    _move_pointer(spark, path, {"version": version, "files": files, "recipe": recipe, "rows": total})
    return Report(version, total - reused, reused, gone)

"""Record stores on shared storage: immutable snapshots, and commits that publish them one at a time.

    <path>/snapshots/<name>/     Parquet files of one state of the store, written once
    <path>/commits/<version>     which snapshot a version is, its next record id and a digest of its records

A commit file appears by one rename, and only if no other writer has published that version.  Until then readers see
the version before it; a writer that dies leaves a snapshot that no commit names, which ``vacuum`` removes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.operators.records import problems
from lexiscope.plans.storage import content_digest

FORMAT = 1


class StaleStoreError(RuntimeError):
    """Another writer has published this version."""


@dataclass(frozen=True)
class Snapshot:
    """One version of a store: its records, and the id that the next new record gets.  Version 0 is the empty store."""

    version: int
    records: DataFrame | None
    next_id: int = 1
    digest: str = ""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, where = _files(spark, f"{path}/commits")
    names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(x) for x in names if x.isdigit())


def _told(spark: SparkSession, path: str, version: int) -> dict:
    told = json.loads(spark.read.text(f"{path}/commits/{version:012d}", wholetext=True).first()["value"])
    if told.get("format_version") != FORMAT:
        raise ValueError(f"format version {told.get('format_version')} of {path}, not {FORMAT}")
    return told


def current(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The last version of a store, or the one asked for; an empty one if there is none."""
    found = _versions(spark, path)
    if version is None:
        version = found[-1] if found else 0
    if version == 0:
        return Snapshot(0, None)
    if version not in found:
        raise ValueError(f"{path} has no version {version}")
    told = _told(spark, path, version)
    return Snapshot(version, spark.read.parquet(f"{path}/snapshots/{told['snapshot']}"), told["next_record_id"], told["digest"])


def _digest(records: DataFrame) -> tuple[str, int, int]:
    """A digest of the records in any order, with their number and their highest id."""
    row = records.agg(F.count("*").alias("n"), F.max("record_id").alias("top")).first()
    return content_digest(records), row["n"], row["top"] or 0


def stage(records: DataFrame, path: str) -> str:
    """The first step of a commit: the records as a snapshot that no commit names yet."""
    name = uuid.uuid4().hex
    records.write.parquet(f"{path}/snapshots/{name}")
    return name


def publish(spark: SparkSession, path: str, version: int, told: dict) -> None:
    """The last step of a commit: its file appears, whole, unless that version is taken."""
    files, folder = _files(spark, f"{path}/commits")
    files.mkdirs(folder)
    jvm = spark._jvm.org.apache.hadoop.fs
    draft, final = jvm.Path(f"{path}/commits/.draft-{uuid.uuid4().hex}"), jvm.Path(f"{path}/commits/{version:012d}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(told).encode()))
    out.hsync()
    out.close()
    context = jvm.FileContext.getFileContext(files.makeQualified(folder).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = getattr(jvm.Options, "Rename").NONE
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), options)
    except Exception as e:
        files.delete(draft, False)
        if files.exists(final):
            raise StaleStoreError(f"version {version} of {path} is taken") from e
        raise


def commit(records: DataFrame, path: str, base: Snapshot, force: bool = False) -> Snapshot:
    """The version behind ``base``, with these records.  Records equal to those of ``base`` are not written again unless
    ``force``.  The next id never falls, so ids of deleted records aren't dealt again.  Records that ``problems`` objects
    to are an error, and so is a version that another writer has published meanwhile."""
    spark = records.sparkSession
    name = stage(records, path)
    written = spark.read.schema(records.schema).parquet(f"{path}/snapshots/{name}")
    wrong = problems(written).limit(3).collect()
    if wrong:
        raise ValueError(f"not a store: {wrong}")
    digest, n, top = _digest(written)
    if digest == base.digest and not force:
        return base
    next_id = max(base.next_id, top + 1)
    publish(spark, path, base.version + 1, {"format_version": FORMAT, "snapshot": name, "next_record_id": next_id, "records": n, "digest": digest})
    return Snapshot(base.version + 1, written, next_id, digest)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the snapshots that none of the last ``keep`` versions names, and the commits before those; how many
    snapshots went.  Not to be run beside a writer."""
    versions = _versions(spark, path)
    named = {_told(spark, path, v)["snapshot"] for v in versions[-keep:]}
    files, where = _files(spark, f"{path}/snapshots")
    gone = 0
    for v in versions[:-keep]:
        files.delete(_files(spark, f"{path}/commits/{v:012d}")[1], False)
    for x in files.listStatus(where) if files.exists(where) else []:
        if x.getPath().getName() not in named:
            files.delete(x.getPath(), True)
            gone += 1
    return gone

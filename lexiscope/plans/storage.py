"""Tables in the folder that driver and executors share: cutting lineage in loops, and results kept by their content."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share; where none is set, a folder of this machine if
    the executors are on it too."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lexiscope-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back, so that readers prune columns and know its size."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def removed(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_written_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def content_digest(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order: sums of the SHA-256 of all rows."""
    kinds = dict(df.dtypes)
    columns = [F.array_sort(F.map_entries(f"`{c}`")).alias(c) if kinds[c].startswith("map<") else F.col(f"`{c}`") for c in sorted(kinds)]
    text = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    row = df.agg(F.count("*"), *(F.sum(F.conv(F.substring(text, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4))).first()
    return ";".join(f"{c} {kinds[c]}" for c in sorted(kinds)) + ";" + ",".join(map(str, row))


def persisted(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none, ``build()`` is written beside it first and appears there whole.  A writer
    that dies leaves nothing at ``path``; of two at a time, the first one's table stays."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
        build().write.parquet(draft.toString())
        if files.exists(where) or not files.rename(draft, where):
            files.delete(draft, True)
    return spark.read.parquet(path)


def terminology_home(spark: SparkSession) -> str:
    """Where what follows from terminologies is kept."""
    return f"{shared_folder(spark)}/terminologies"

"""Shared-storage helpers: where intermediate tables go, and how kernels reach the executors."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module_name: str) -> None:
    """Let the functions of a module travel inside the task, so executors need no copy of this package."""
    register_pickle_by_value(sys.modules[module_name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, as in tests, a
    temporary one of this machine will do if the executors are on it too; otherwise this raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lexiscope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, and
    gives the optimizer true sizes, so that it broadcasts a side only after having checked its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiscope/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lexiscope_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_lexiscope_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (case ignored), for helper columns beside a caller's own."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df`` as they came, whatever characters are in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def hashes(values: list[Column], kinds: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the values together, which differ for null at one place and at another; ``kinds`` are their
    types, as maps have no hash and go in as JSON."""
    plain = [F.to_json(F.struct(v.alias("v"))) if "map<" in k else v for v, k in zip(values, kinds)]
    gaps = [v.isNull() for v in values]
    return F.xxhash64(*plain, *gaps), F.xxhash64(F.lit(0x5DEECE66D), *plain, *gaps)

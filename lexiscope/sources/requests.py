"""Records from a service that answers for many keys at a time.

Distinct keys are dealt over a few tasks, each of which sends one request at a time: the number of tasks and the spacing
bound the rate of all of them together.  Answers are written before they are read, so each key is asked for once, and
again only if a task is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.plans.storage import settled, shared_folder

ANSWERS = "keys array<string>, tries int, body string, error string"


def http_get(template: str, timeout: float = 30.0) -> Callable[[list[str]], str]:
    """A call that puts the keys, joined by commas and quoted, in place of ``{keys}`` and returns the body."""

    def call(keys: list[str]) -> str:
        from urllib.parse import quote
        from urllib.request import urlopen

        with urlopen(template.replace("{keys}", quote(",".join(keys))), timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode("utf-8")

    return call


def ask(keys: DataFrame, call: Callable[[list[str]], str], size: int = 250, spacing: float = 0.4, tries: int = 3, tasks: int = 1) -> DataFrame:
    """``(keys, tries, body, error)``, one row for each request of at most ``size`` of the distinct, non-null ``keys(value)``.

    A request begins ``spacing`` seconds behind the one before it in its task at least; one that fails is sent up to
    ``tries`` times, after twice the spacing, then four times it, and so on.  The body is null, and the error told, where all fail.
    """
    if size < 1 or tries < 1 or tasks < 1:
        raise ValueError("size, tries and tasks are 1 at least")

    def run(batches: Iterator) -> Iterator:
        import time

        import pandas as pd

        held: list[str] = []
        free = 0.0

        def send(some: list[str]) -> pd.DataFrame:
            nonlocal free
            wait, error = spacing, None
            for n in range(1, tries + 1):
                time.sleep(max(0.0, free - time.monotonic()))
                free = time.monotonic() + wait
                try:
                    return pd.DataFrame({"keys": [some], "tries": [n], "body": [call(some)], "error": [None]})
                except Exception as e:  # noqa: BLE001  whatever the call raises is told
                    error, wait = f"{type(e).__name__}: {e}", wait * 2
                    free = time.monotonic() + wait
            return pd.DataFrame({"keys": [some], "tries": [tries], "body": [None], "error": [error]})

        for batch in batches:
            held.extend(batch["value"])
            while len(held) >= size:
                yield send(held[:size])
                del held[:size]
        if held:
            yield send(held)

    wanted = keys.select(F.col("value").cast("string").alias("value")).filter("value IS NOT NULL").distinct()
    return settled(wanted.repartition(tasks, "value").mapInPandas(run, ANSWERS))


def parsed(answers: DataFrame, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What ``read(spark, path)``, a reader of payload files, makes of the bodies, each of which is a file."""
    spark = answers.sparkSession
    path = f"{shared_folder(spark)}/answers/{uuid.uuid4().hex}"
    answers.filter("body IS NOT NULL").select("body").write.option("maxRecordsPerFile", 1).text(path)
    return read(spark, path)

"""Reasoning over a stream of added triples: each micro-batch is added to the result of those before it.

The result lies in a folder: ``data`` has what each batch added, ``commits`` a small file for each finished batch that names its data. A batch reads the commits of
smaller numbers only and is finished by one rename, so a batch that fails half way leaves nothing that another reads, and is computed from
the same state when it is run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.rules import GROUPS, infer

_SCHEMA = "s string, p string, o string, level int, rule string"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def commits(spark: SparkSession, folder: str) -> dict[int, str]:
    """Finished batches and where their data lie."""
    files, at = _files(spark, f"{folder}/commits")
    if not files.exists(at):
        return {}
    names = [x.getPath().getName() for x in files.listStatus(at)]
    return {int(n.split("-", 1)[0]): f"{folder}/data/{n.split('-', 1)[1]}" for n in names if n[0].isdigit()}


def _commit(spark: SparkSession, folder: str, number: int, name: str) -> None:
    """One rename of an empty file whose name says all."""
    files, draft = _files(spark, f"{folder}/drafts/{uuid.uuid4().hex}")
    files.create(draft).close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/{number:012d}-{name}")
    files.mkdirs(final.getParent())
    if not files.rename(draft, final):
        raise OSError(f"batch {number} could not be committed")


def state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """(s, p, o, level, rule) of all finished batches, or those before a number; None if there is none."""
    parts = [path for n, path in sorted(commits(spark, folder).items()) if before is None or n < before]
    return spark.read.schema(_SCHEMA).parquet(*parts) if parts else None


def reason_stream(additions: DataFrame, folder: str, checkpoint: str, groups: tuple[str, ...] = GROUPS, available_now: bool = True) -> StreamingQuery:
    """For each micro-batch of triples: infer what it adds to the ``state`` of ``folder``, and commit that. Both folders must be
    shared by all executors. A batch that was committed already, before Spark could note it, is not run again."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in commits(spark, folder):
            return
        before = state(spark, folder, number)
        after = infer(batch, groups, start=before)
        name = uuid.uuid4().hex
        (after if before is None else after.join(before, ["s", "p", "o"], "left_anti")).write.parquet(f"{folder}/data/{name}")
        _commit(spark, folder, number, name)

    stream = additions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()

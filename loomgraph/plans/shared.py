"""Lineage cuts, joins that stand hot keys, and prefix sums without a single task."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that are looked up by broadcast in ``attach``; any other key holds at most 1 / (HOT_KEYS + 1) of the rows.
HOT_KEYS = 1000
#: From so many rows on, staged triples are not broadcast.
MERGED_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder of ``spark.checkpoint.dir`` (a fresh folder only where that is unset).

    A checkpoint keeps its plan's constraints, which multiply in long loops; there ``staged`` is the one to use.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def merged(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of joins that are not by broadcast, where it may have ``rows`` of MERGED_ROWS or more. Triples in files take a fiftieth of their memory, so by
    the files' size Spark would send millions of them to the driver and all executors."""
    return df.hint("merge") if rows >= MERGED_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(left: DataFrame, counted: DataFrame, key: str, n: str, spread: str | Column) -> DataFrame:
    """``left`` joined (left outer) to ``counted``, which has one row per ``key`` and in ``n`` the rows of ``left`` with it.

    The HOT_KEYS largest groups are matched by a broadcast of that many rows; rows matched so are dealt by
    ``spread`` in the join that serves the rest, so no task gets a hot group. Null keys stay unmatched. The key may be a struct.
    ``counted`` is read twice, so it should be staged.
    """
    values = [c for c in counted.columns if c != key]
    hot = counted.filter(F.col(n) > 1).orderBy(F.desc(n), key).limit(HOT_KEYS).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    rest = counted.select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*values).alias("_cold"))
    salted = left.join(F.broadcast(hot), left[key] == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull() & left[key].isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int")
    )
    joined = salted.join(rest, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*left.columns, *[found[c].alias(c) for c in values])


def hub_join(left: DataFrame, right: DataFrame, keys: list[str], each: int = 100_000) -> DataFrame:
    """The inner join on ``keys``, which must be bound, where both sides may have any number of rows for a key.

    A key with more than ``each`` rows on a side is a hub: its rows there are split by a hash into parts of about ``each``, and the other side's rows with it go
    to every part. The HOT_KEYS largest hubs are known from one count of both sides' keys, and broadcast. Equal rows go to one part. Strings are counted by their
    hash: keys with the hash of a hub are split like it, on both sides.
    """
    sides = {"_l": left, "_r": right}
    hashed = all(dict(df.dtypes)[k] == "string" for df in sides.values() for k in keys)

    def counted(df: DataFrame) -> list[Column]:
        return [F.xxhash64(*[df[k] for k in keys])] if hashed else [df[k] for k in keys]

    names = [f"_hub{i}" for i in range(1 if hashed else len(keys))]
    marked = [df.select(*[x.alias(c) for x, c in zip(counted(df), names, strict=True)], *[F.lit(int(n == own)).alias(n) for n in sides]) for own, df in sides.items()]
    counts = marked[0].unionByName(marked[1]).groupBy(*names).agg(*[F.sum(n).alias(n) for n in sides])
    hubs = counts.filter((F.greatest(*sides) > each) & (F.least(*sides) > 0)).orderBy(F.desc(F.col("_l") + F.col("_r")), *names).limit(HOT_KEYS)
    hubs = hubs.select(*names, *[F.ceil(F.col(n) / each).cast("int").alias(f"_parts{n}") for n in sides])

    def dealt(own: str, other: str) -> DataFrame:
        df = sides[own]
        on = reduce(lambda a, b: a & b, [x == F.col(c) for x, c in zip(counted(df), names, strict=True)])
        mine = F.pmod(F.xxhash64(*df.columns, F.lit(own)), F.coalesce(f"_parts{own}", F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(f"_parts{other}", F.lit(1)) - 1))
        return df.join(F.broadcast(hubs), on, "left").withColumn(f"_at{own}", mine).withColumn(f"_at{other}", theirs).select(*df.columns, "_at_l", "_at_r")

    return dealt("_l", "_r").join(dealt("_r", "_l").hint("merge"), [*keys, "_at_l", "_at_r"]).drop("_at_l", "_at_r")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: Column, to: str, buckets: int = 1024, bucket: Column | None = None) -> DataFrame:
    """Adds ``to``: the sum of ``value`` over the rows before this one in its group.

    The order is by ``bucket``, then ``order``; by default a hash bucket, and a column that rises with ``order`` for the order itself.
    Only one row per group and bucket is summed along the group, so a hot group is spread over its buckets. ``group`` columns must not be null.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)) if bucket is None else bucket).withColumn("_value", value)
    keys = [*group, "_bucket"]
    totals = dealt.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(offsets, keys).withColumn(to, F.col("_offset") + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("_bucket", "_value", "_offset")


def rows_for(spark: SparkSession, total: int, each: int) -> int:
    """A number of partitions for ``total`` units of work with about ``each`` in one; never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Where neither is set, a local session gets a fresh temporary folder; on a cluster this raises, as a local folder is not shared.
    """
    context = spark.sparkContext
    found, given = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if not found and not given and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = given or f"file://{tempfile.mkdtemp(prefix='loomgraph-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not given:
        context.setCheckpointDir(found)
    return found


def stage(df: DataFrame) -> str:
    """Writes ``df`` as Parquet into a new folder of the shared one and returns its path. The files stay until ``unstage``, as
    later jobs of the caller read them."""
    path = f"{shared_folder(df.sparkSession)}/loomgraph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` read from where it was staged: compressed, read by column, without its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(stage(df))


def unstage(spark: SparkSession, *paths: str) -> None:
    """Deletes staged folders that no later job reads."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def clear_staged(spark: SparkSession) -> int:
    """Deletes all that was staged in the shared folder by any run, and says how many folders that were. For when no result is read any more."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/loomgraph-*")
    files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = files.globStatus(top) or []
    for x in found:
        files.delete(x.getPath(), True)
    return len(found)

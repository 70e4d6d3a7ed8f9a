"""Plan helpers that keep work spread over executors.

``shared_dir``/``cut``: durable lineage cuts in the folder all executors share.
``small``: a broadcast that proves its size first. ``salted_join``: an equi-join
whose hot keys are cut into blocks on both sides. ``ranked``: a row number within a key that
never puts one key's rows into one task.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    there = tempfile.mkdtemp(prefix="tarnloom-")
    spark.sparkContext.setCheckpointDir(there)
    return spark.sparkContext.getCheckpointDir()


def _clean(path: str) -> None:
    spark = _made.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tarnloom/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    atexit.register(_clean, path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: later jobs
    start from the files, on whatever executors are left."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes every table that ``cut`` wrote so far; for long sessions, between jobs, once
    the frames made from them have been read."""
    for path in list(_made):
        _clean(path)


def small(df: DataFrame, limit: int = 200_000, most: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if one count proves that it has at most ``limit`` rows
    and ``most`` bytes (texts and arrays measured, other values 16 each), else as it is
    (the join then shuffles)."""
    wide = {"string": F.octet_length, "binary": F.octet_length}
    sizes = [wide[kind](name) if kind in wide else F.size(name) * 32 for name, kind in df.dtypes if kind in wide or kind.startswith("array")]
    width = reduce(lambda x, y: x + F.coalesce(y, F.lit(0)), sizes, F.lit(16 * len(df.columns)))
    rows, width = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= limit and (width or 0) <= most else df


def listed(spark: SparkSession, rows: list, schema: str, limit: int = 200_000) -> DataFrame:
    """Rows that the driver holds already, marked for broadcast if they are few."""
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= limit else frame


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, block: int) -> DataFrame:
    """Inner equi-join on ``keys``; no row is lost or repeated.

    ``hot`` gives, by key, ``n`` rows on the right and, where the left may have
    many as well, ``m`` rows on the left. A key above ``block`` on either side is
    cut into a grid: right rows into n / block parts, left rows into m / block,
    and each part of one side meets every part of the other, so no task has more
    than about ``block`` rows of a key from either side. Other keys join as usual.
    """
    parts_of = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    sides = ["n", "m"] if "m" in hot.columns else ["n"]
    above = reduce(lambda x, y: x | y, [F.col(c) > block for c in sides])
    parts = hot.where(above).select(*keys, parts_of("n").alias("_right"), parts_of("m").alias("_left") if "m" in sides else F.lit(1).alias("_left"))
    if not parts.take(1):
        return left.join(right, keys)
    mark = small(parts)

    def cells(side: DataFrame, own: str, other: str) -> DataFrame:
        known = [F.col(c) for c in side.columns if c not in keys]
        marked = side.join(mark, keys, "left").withColumns({"_left": F.coalesce("_left", F.lit(1)), "_right": F.coalesce("_right", F.lit(1))})
        place = F.pmod(F.xxhash64(*known), F.col(own)).cast("int") if known else F.lit(0)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return marked.withColumn(f"_at{own}", place).withColumn(f"_at{other}", every).drop("_left", "_right")

    at = ["_at_left", "_at_right"]
    return cells(left, "_left", "_right").join(cells(right, "_right", "_left"), [*keys, *at]).drop(*at)


def lookup(known: DataFrame, rows: DataFrame, keys: list[str], block: int = 50_000) -> DataFrame:
    """``rows`` that have one of the keys of ``known``, with its columns; each key is there once.
    Few keys are broadcast; otherwise keys of more than ``block`` rows are cut into blocks."""
    few = small(known)
    if few is not known:
        return rows.join(few, keys)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    return salted_join(known, rows, keys, hot, block)


def ranked(df: DataFrame, key: str, order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, a 0-based dense position among the rows of each ``key``.

    Rows are range-partitioned by (key, order) and numbered inside each
    partition; what precedes a partition in the same key comes from a table of
    counts by (partition, key), which has at most partitions + keys rows. ``key``
    must have few values (a size, a kind); a key of any share is spread over
    partitions.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(df.repartitionByRange(n, key, *order).withColumn("_p", F.spark_partition_id()), name)
    counts = spread.groupBy("_p", key).count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = spread.withColumn("_in", F.row_number().over(Window.partitionBy("_p", key).orderBy(*order)) - 1)
    return inside.join(small(before.drop("count")), ["_p", key]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_p", "_before", "_in")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

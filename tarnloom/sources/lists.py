"""Long name lists, stored by content and referred to by hash."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from .catalog import SCHEMAS, Catalog

INLINE_MOST = 200


def tidy(names: list[str]) -> list[str]:
    """Names stripped, blanks dropped; order and repeats stay."""
    return [n for n in (x.strip() for x in names) if n]


def digest(names: list[str]) -> str:
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def digest_column(names: str):
    """The same digest of an array column, in the plan."""
    return F.sha2(F.array_join(names, "\n"), 256)


def register(spark: SparkSession, path: str, names: list[str], note: str | None = None) -> str:
    """Stores a list under ``path`` unless one of that content is there; returns its hash."""
    own = tidy(names)
    if not own:
        raise SpecError("a list needs at least one name")
    key = digest(own)
    if not any(r[0] == key for r in browse(spark, path).where(F.col("sha256") == key).select("sha256").take(1)):
        schema = T.StructType.fromDDL(SCHEMAS["import_lists"])
        spark.createDataFrame([(key, own, note, datetime.datetime.now(datetime.timezone.utc))], schema).write.mode("append").parquet(path)
    return key


def browse(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, names, source_note, created_at), newest first."""
    from pyspark.errors import AnalysisException

    try:
        own = spark.read.schema(SCHEMAS["import_lists"]).parquet(path)
    except AnalysisException:
        own = spark.createDataFrame([], T.StructType.fromDDL(SCHEMAS["import_lists"]))
    return own.select("sha256", F.size("file_names").alias("names"), "source_note", "created_at").orderBy(F.col("created_at").desc(), "sha256")


def fetch(catalog: Catalog, prefix: str) -> list[str]:
    """The list of a hash, or of a prefix that only one list has."""
    lists = catalog.table("import_lists")
    rows = lists.where(F.col("sha256") == prefix).take(1)
    if not rows and prefix:
        rows = lists.where(F.col("sha256").startswith(prefix)).dropDuplicates(["sha256"]).take(2)
    if len(rows) != 1:
        raise SpecError(f"list {prefix!r} is {'ambiguous' if rows else 'not registered; register it with `lists add`'}")
    return list(rows[0]["file_names"])


def names_frame(catalog: Catalog, names: list[str] | None, ref: dict | None) -> tuple[DataFrame, int, int]:
    """(file_name) distinct, the number of names and of repeats, from an inline list or a reference."""
    own = names or fetch(catalog, ref["sha256"])
    if not own:
        raise SpecError("the list is empty")
    distinct = list(dict.fromkeys(own))
    frame = catalog.spark.createDataFrame([(n,) for n in distinct], "file_name string")
    return frame, len(own), len(own) - len(distinct)

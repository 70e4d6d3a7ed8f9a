"""Bringing deliveries into the warehouse.

Each transform takes frames and gives the rows to append, the values that stored
rows get, and a row with its reason for everything that was left out; ``store``
writes them. Everything is joins and anti-joins, so a delivery of any size is
spread, and a delivery that comes again adds nothing.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.spread import cut, ranked, small
from .catalog import SCHEMAS, Catalog

PLACEHOLDER_DATES = ("", "0000-00-00")  # fixed values


@dataclass
class Delivery:
    """Rows to append by table, rows left out with the reason, and, by table, rows (id, values)
    whose values replace those stored."""

    rows: dict[str, DataFrame]
    refused: DataFrame
    updates: dict[str, DataFrame] = field(default_factory=dict)


def clean_date(column: str):
    """A date, or null for a placeholder or what is no date."""
    text = F.trim(F.col(column).cast("string"))
    return F.when(text.isin(*PLACEHOLDER_DATES), None).otherwise(text).try_cast("date")


def clean_hash(column: str):
    text = F.lower(F.trim(F.col(column)))
    return F.when(text.rlike(r"\A[0-9a-f]{64}\z"), text)


def next_ids(frame: DataFrame, existing: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``frame`` with new ids that follow the existing ones, in the given order."""
    top = existing.agg(F.max("id")).first()[0] or 0
    return ranked(frame.withColumn("_k", F.lit(1)), "_k", order, name).drop("_k").withColumn(name, F.col(name) + top + 1)


def _refuse(rows: DataFrame, kind: str, number: str, reason: str) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col(number).cast("long").alias("id"), F.lit(reason).alias("reason"))


def _named(given: DataFrame, stored: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """New rows (id, name, *extra) for names that are not stored, and (given_id, id) of all given
    rows (id, name, *extra). A name that is given twice is one row."""
    known = stored.groupBy("name").agg(F.min("id").alias("_stored"))
    own = given.groupBy("name").agg(F.min(F.struct("id", *extra)).alias("_s")).join(known, "name", "left")
    fresh = next_ids(own.where("_stored is null").select("name", *[F.col(f"_s.{c}").alias(c) for c in extra]), stored, ["name"])
    every = known.select("name", F.col("_stored").alias("_to")).union(fresh.select("name", "id"))
    return fresh.select("id", "name", *extra), given.select(F.col("id").alias("_given"), "name").join(every, "name").select("_given", "_to")


def annotation_batch(catalog: Catalog, original_set: str, batch: int, files: dict[str, DataFrame], on_missing: str = "error", on_duplicate: str = "error") -> Delivery:
    """An annotation delivery: ``files`` holds images (id, file_name, source_version, license?,
    date_captured?) and optionally cls_annotations, det_annotations, categories, annotators, licenses.

    Images are found by the batch version they name and their file name; missing
    ones are an error or are skipped with their annotations. Licences and capture
    dates fill gaps of stored images. Boxes without four numbers, annotations whose
    category or annotator is not in the delivery, repeats of a claim and claims that
    the batch has already are refused; NaN scores are null, null classification
    scores are 0. Categories, annotators and licences are found by name before new
    ones are made, and only categories that are used are.
    """
    if "images" not in files:
        raise SpecError("a delivery needs images.parquet")
    given = files["images"]
    registered = catalog.images().where(F.col("original_set") == original_set).select("image_id", F.col("batch_version").alias("source_version"), "file_name")
    optional = [c for c in ("license", "date_captured") if c in given.columns]
    named = given.select(F.col("id").alias("_local"), "file_name", "source_version", *optional)
    found = named.join(registered, ["source_version", "file_name"], "left")
    lost = found.where("image_id is null")
    if on_missing == "error" and (first := lost.orderBy("file_name").take(5)):
        raise SpecError(f"images that are not registered: {', '.join(r['file_name'] for r in first)}")
    known = found.where("image_id is not null")
    refused = _refuse(lost, "image", "_local", "not registered")

    out: dict[str, DataFrame] = {}
    updates: dict[str, DataFrame] = {}
    if optional:
        facts = known
        if "license" in optional and "licenses" in files:
            text = files["licenses"].withColumn("url", F.col("url") if "url" in files["licenses"].columns else F.lit(None).cast("string"))
            out["licenses"], ids = _named(text.select("id", "name", "url"), catalog.table("licenses"), ["url"])
            facts = facts.join(small(ids.withColumnRenamed("_given", "license")), "license", "left").withColumn("_license", F.col("_to"))
        else:
            facts = facts.withColumn("_license", F.lit(None).cast("long"))
        facts = facts.withColumn("_date", clean_date("date_captured") if "date_captured" in optional else F.lit(None).cast("date"))
        facts = facts.groupBy(F.col("image_id").alias("id")).agg(F.min("_license").alias("_license"), F.min("_date").alias("_date"))
        both = catalog.table("images").select("id", "license_id", "date_captured").join(facts, "id")
        gaps = both.where("(license_id is null and _license is not null) or (date_captured is null and _date is not null)")
        updates["images"] = gaps.select("id", F.coalesce("license_id", "_license").alias("license_id"), F.coalesce("date_captured", "_date").alias("date_captured"))

    claims: dict[str, DataFrame] = {}
    for kind in ("cls", "det"):
        rows = files.get(f"{kind}_annotations")
        if rows is None:
            continue
        own = rows.withColumnRenamed("image_id", "_local").join(known.select("_local", "image_id"), "_local")
        score = F.col("score").cast("double") if "score" in rows.columns else F.lit(None).cast("double")
        own = own.withColumn("score", F.when(~F.isnan(score), score))
        if kind == "det":
            ok = F.coalesce(F.size("bbox") == 4, F.lit(False))
            refused = refused.union(_refuse(own.where(~ok), "det", "_local", "box is not four numbers"))
            own = own.where(ok)
            for name, kind_, default in (("segmentation", "string", None), ("iscrowd", "smallint", 0)):
                own = own.withColumn(name, F.coalesce(F.col(name).cast(kind_), F.lit(default).cast(kind_)) if name in rows.columns else F.lit(default).cast(kind_))
            columns = ["image_id", "category_id", "bbox", "segmentation", "iscrowd", "score", "annotator_id"]
        else:
            own = own.withColumn("score", F.coalesce("score", F.lit(0.0)))
            columns = ["image_id", "category_id", "score", "annotator_id"]
        counted = own.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        twice = counted.where("_n > 1")
        if on_duplicate == "error" and twice.take(1):
            raise SpecError(f"{kind} claims that are made twice: {twice.count()}")
        refused = refused.union(_refuse(twice, kind, "image_id", "claim made twice"))
        claims[kind] = counted.select(*columns)

    def by_name(table: str, column: str, ids: DataFrame) -> None:
        nonlocal refused
        mark = small(ids.withColumnRenamed("_given", column))
        for kind, own in claims.items():
            marked = own.join(mark, column, "left")
            refused = refused.union(_refuse(marked.where("_to is null"), kind, "image_id", f"{table} not in the delivery"))
            claims[kind] = marked.where("_to is not null").drop(column).withColumnRenamed("_to", column)

    if "categories" in files and claims:
        used = reduce(DataFrame.union, [c.select("category_id") for c in claims.values()]).distinct()
        cats = files["categories"].join(used, F.col("id") == F.col("category_id"), "left_semi")
        cats = cats.withColumn("supercategory", F.col("supercategory") if "supercategory" in cats.columns else F.lit(None).cast("string"))
        stored = catalog.table("categories")
        here = stored.where(F.col("annotation_batch_id") == batch).select("id", "name")
        top = stored.agg(F.max("id").alias("id")).withColumn("name", F.lit(None).cast("string"))  # ids follow all batches' ids
        fresh, ids = _named(cats.select("id", "name", "supercategory"), here.union(top), ["supercategory"])
        out["categories"] = fresh.select("id", F.lit(batch).cast("long").alias("annotation_batch_id"), "name", "supercategory")
        by_name("category", "category_id", ids)
    if "annotators" in files:
        out["annotators"], ids = _named(files["annotators"].select("id", "name"), catalog.table("annotators").select("id", "name"), [])
        by_name("annotator", "annotator_id", ids)
    for kind, own in claims.items():
        columns = [c for c in own.columns]
        stored = catalog.table(f"{kind}_annotations").where(F.col("annotation_batch_id") == batch).select(*columns).distinct().withColumn("_there", F.lit(True))
        same = reduce(lambda x, y: x & y, [own[c].eqNullSafe(stored[c]) for c in columns])
        refused = refused.union(_refuse(own.join(stored, same, "left_semi"), kind, "image_id", "stored already"))
        fresh = own.join(stored, same, "left_anti").withColumn("annotation_batch_id", F.lit(batch).cast("long"))
        order = [c for c in ("image_id", "category_id", "annotator_id", "score", "bbox") if c in columns]
        out[f"{kind}_annotations"] = next_ids(fresh, catalog.table(f"{kind}_annotations"), order)
    return Delivery(out, refused, updates)


def image_batch(catalog: Catalog, batch: int, files: DataFrame, on_conflict: str = "error") -> Delivery:
    """An image delivery (file_name, width, height, blake3_hash?, license_id?, date_captured?,
    subject_id?): names that the batch has already are an error, are skipped, or
    (``overwrite``) get the delivered values. Of rows of one name the smallest counts,
    the others are refused."""
    there = catalog.table("images").where(F.col("image_batch_id") == batch).groupBy("file_name").agg(F.min("id").alias("_id"))
    clash = files.join(there, "file_name", "left_semi")
    if on_conflict == "error" and (first := clash.orderBy("file_name").take(5)):
        raise SpecError(f"file names that are registered already: {', '.join(r['file_name'] for r in first)}")
    others = [c for c in files.columns if c != "file_name"]
    counted = files.groupBy("file_name").agg(F.min(F.struct(*others)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    twice = counted.where("_n > 1").select(F.lit("image").alias("kind"), F.lit(None).cast("long").alias("id"), F.concat(F.lit("delivered more than once: "), F.col("file_name")).alias("reason"))
    own = counted.select("file_name", *[F.col(f"_s.{c}").alias(c) for c in others])
    optional = lambda name, kind, made=None: (made if made is not None else F.col(name).cast(kind)).alias(name) if name in files.columns else F.lit(None).cast(kind).alias(name)
    values = [F.col("width").cast("int"), F.col("height").cast("int"), optional("blake3_hash", "string", clean_hash("blake3_hash") if "blake3_hash" in files.columns else None), optional("license_id", "long"), optional("date_captured", "date", clean_date("date_captured") if "date_captured" in files.columns else None)]
    rows = next_ids(own.join(there, "file_name", "left_anti"), catalog.table("images"), ["file_name"])
    out = {"images": rows.select("id", F.lit(batch).cast("long").alias("image_batch_id"), "file_name", *values)}
    if "subject_id" in files.columns:
        out["image_subjects"] = rows.where("subject_id <> ''").select(F.col("id").alias("image_id"), "subject_id")
    updates = {"images": own.join(there, "file_name").select(F.col("_id").alias("id"), *values)} if on_conflict == "overwrite" else {}
    kept = clash.select(F.lit("image").alias("kind"), F.lit(None).cast("long").alias("id"), F.concat(F.lit("registered already: "), F.col("file_name")).alias("reason"))
    return Delivery(out, twice if on_conflict == "overwrite" else kept.union(twice), updates)


def replaced(table: DataFrame, update: DataFrame) -> DataFrame:
    """``table`` with the values of ``update`` (id, columns): where the update has a value, it counts."""
    new = [c for c in update.columns if c != "id"]
    renamed = update.select("id", *[F.col(c).alias(f"_new_{c}") for c in new])
    return table.join(renamed, "id", "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in table.columns])


def store(catalog: Catalog, path: str, delivery: Delivery) -> dict[str, int]:
    """Writes a delivery to the tables under ``path``; gives the rows appended and updated by table.

    All parts are made before any is written. Updated tables are written beside the
    old ones and take their place by renaming.
    """
    spark = catalog.spark
    made = {t: cut(rows, t) for t, rows in delivery.rows.items()}
    changed = {t: cut(rows, t) for t, rows in delivery.updates.items()}
    counts = {}
    for table, rows in changed.items():
        if n := rows.count():
            whole = cut(replaced(catalog.table(table), rows), table)
            whole.write.mode("overwrite").parquet(f"{path}/_{table}_new")
            swap(spark, path, table)
            counts[f"{table} updated"] = n
    for table, rows in made.items():
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        if n := rows.count():
            rows.select(*columns).write.mode("append").parquet(f"{path}/{table}")
            counts[table] = n
    return counts


def swap(spark, path: str, table: str) -> None:
    """``_table_new`` in the place of ``table``; the old files stay until the new ones are there."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(f"_{table}_old"), True)
    for name in (table, f"{table}.parquet"):
        if fs.exists(at(name)):
            fs.rename(at(name), at(f"_{table}_old"))
    fs.rename(at(f"_{table}_new"), at(table))
    fs.delete(at(f"_{table}_old"), True)


def image_files(spark, path: str, suffixes: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".dcm")) -> DataFrame:
    """(file_name, width, height, bits, content_sha256) of the image files under a path.

    PNG and JPEG headers are read here, a JPEG's wherever its size marker lies; other
    files have null sizes. The content
    hash is SHA-256, which is a built-in; BLAKE3 hashes come from the delivery.
    """
    pattern = "(?i)(" + "|".join(re.escape(s) for s in suffixes) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(pattern))
    head = F.when(F.substring("content", 1, 2) == F.unhex(F.lit("FFD8")), F.col("content")).otherwise(F.substring("content", 1, 64))
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), head.alias("head"), F.sha2("content", 256).alias("content_sha256"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [header(bytes(h)) for h in part["head"]]
            yield pd.DataFrame({"file_name": part["file_name"], "width": pd.array([f[0] for f in found], "Int32"), "height": pd.array([f[1] for f in found], "Int32"), "bits": pd.array([f[2] for f in found], "Int32"), "content_sha256": part["content_sha256"]})

    return files.mapInPandas(run, "file_name string, width int, height int, bits int, content_sha256 string")


def header(head: bytes) -> tuple[int | None, int | None, int | None]:
    """(width, height, bits per sample) of a PNG or JPEG by its first bytes; of a JPEG, up to its size marker."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 25:
        return (*struct.unpack(">II", head[16:24]), head[24])
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            kind, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                bits, height, width = struct.unpack(">BHH", head[at + 4 : at + 9])
                return width, height, bits
            at += 2 + size
    return None, None, None


def backfill_hashes(images: DataFrame, hashes: DataFrame) -> DataFrame:
    """Images whose missing hash is filled from (image_id, blake3_hash); others stay as they are."""
    known = hashes.select(F.col("image_id").alias("id"), clean_hash("blake3_hash").alias("_h")).where("_h is not null").groupBy("id").agg(F.min("_h").alias("_h"))
    return images.join(known, "id", "left").withColumn("blake3_hash", F.coalesce("blake3_hash", "_h")).select(images.columns)


def build_lineage(catalog: Catalog, parent_batch: int, child_batch: int, rewrite: tuple[str, str] | None = None) -> DataFrame:
    """(parent_image_id, child_image_id): new edges between images of two batches whose names
    agree, after rewriting the child's name by (pattern, replacement).

    Existing edges are left out; an edge that exists the other way round is an error.
    """
    if parent_batch == child_batch:
        raise SpecError("a batch is not derived from itself")
    rows = catalog.table("images")
    child = rows.where(F.col("image_batch_id") == child_batch).select(F.col("id").alias("child_image_id"), (F.regexp_replace("file_name", *rewrite) if rewrite else F.col("file_name")).alias("file_name"))
    parent = rows.where(F.col("image_batch_id") == parent_batch).select(F.col("id").alias("parent_image_id"), "file_name")
    edges = parent.join(child, "file_name").select("parent_image_id", "child_image_id")
    old = catalog.table("image_lineage").select("parent_image_id", "child_image_id")
    turned = old.select(F.col("child_image_id").alias("parent_image_id"), F.col("parent_image_id").alias("child_image_id"))
    if bad := edges.join(turned, ["parent_image_id", "child_image_id"], "left_semi").take(1):
        raise SpecError(f"image {bad[0][1]} is the parent of {bad[0][0]} already")
    return edges.join(old, ["parent_image_id", "child_image_id"], "left_anti")

"""Integrity checks, independent of the operators: every count must be 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import Candidates
from ..sources.catalog import Catalog


def _count(frame: DataFrame, seq: int, name: str) -> DataFrame:
    """One row: the rows of the frame, or the sum of its ``surplus``."""
    n = F.coalesce(F.sum("surplus"), F.lit(0)) if "surplus" in frame.columns else F.count(F.lit(1))
    return frame.agg(n.cast("long").alias("violations")).select(F.lit(seq).alias("seq"), F.lit(name).alias("check"), "violations")


def _surplus(frame: DataFrame, *key: str) -> DataFrame:
    """How many ids beyond the first each key has."""
    return frame.groupBy(*key).agg((F.countDistinct("id") - 1).alias("surplus")).where("surplus > 0").select("surplus")


def source_checks(c: Catalog) -> DataFrame:
    """(seq, check, violations) over the delivered tables."""
    images, cls, det, cats = c.table("images"), c.table("cls_annotations"), c.table("det_annotations"), c.table("categories")
    ids = images.select(F.col("id").alias("image_id"))
    found = [
        (1, "image size not positive", images.where(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)))),
        (2, "hash not 64 hex digits", images.where("blake3_hash is not null").where(~F.col("blake3_hash").rlike(r"\A[0-9a-f]{64}\z"))),
        (3, "file name twice in a batch", images.groupBy("image_batch_id", "file_name").count().where("count > 1")),
        (4, "image of no batch", images.join(c.batches("image").select(F.col("batch_id").alias("image_batch_id")), "image_batch_id", "left_anti")),
        (5, "annotation of no image", cls.select("image_id").union(det.select("image_id")).join(ids, "image_id", "left_anti")),
        (6, "category of another batch", cls.select("category_id", "annotation_batch_id").union(det.select("category_id", "annotation_batch_id")).join(cats.select(F.col("id").alias("category_id"), "annotation_batch_id"), ["category_id", "annotation_batch_id"], "left_anti")),
        (7, "claim made twice (cls)", _surplus(cls, "annotation_batch_id", "image_id", "category_id", "annotator_id", "score")),
        (8, "claim made twice (det)", _surplus(det, "annotation_batch_id", "image_id", "category_id", "annotator_id", "bbox", "segmentation", "iscrowd", "score")),
        (9, "category without annotation", cats.select(F.col("id").alias("category_id")).join(cls.select("category_id").union(det.select("category_id")).distinct(), "category_id", "left_anti")),
        (10, "name twice in a batch", cats.groupBy("annotation_batch_id", "name").count().where("count > 1")),
        (11, "box not of four numbers", det.where(F.coalesce(F.size("bbox"), F.lit(0)) != 4)),
        (12, "lineage in both directions", c.table("image_lineage").alias("a").join(c.table("image_lineage").alias("b"), (F.col("a.parent_image_id") == F.col("b.child_image_id")) & (F.col("a.child_image_id") == F.col("b.parent_image_id")))),
    ]
    return reduce(DataFrame.union, [_count(f, i, n) for i, n, f in found])


def version_checks(own: Candidates, other: Candidates | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(seq, check, violations) over a version with its stored ``targets``, and against another split of it."""
    mapped = own.cls.join(own.targets, "category_id")
    ids = own.images.select("image_id")
    notes = own.cls.select("image_id", "category_id").union(own.det.select("image_id", "category_id"))
    per = mapped.groupBy("target").agg(F.countDistinct("image_id").alias("n"))
    names = own.targets.select("target") if targets is None else targets.select("target")
    used = own.targets.join(own.used_categories().select("category_id"), "category_id", "left_semi").select("target")
    found = [
        (3, "several classifications of an image for a target", mapped.groupBy("image_id", "target").count().where("count > 1")),
        (4, "annotation outside the version", notes.join(ids, "image_id", "left_anti")),
        (5, "content twice", own.images.where("blake3_hash is not null").groupBy("blake3_hash").count().where("count > 1")),
        (6, "target without source", names.distinct().join(used, "target", "left_anti")),
        (7, "annotation without target", notes.join(own.targets, "category_id", "left_anti")),
        (11, "image without annotation", own.images.join(own.annotated(), "image_id", "left_anti")),
        (14, "more labelled images than images", per.withColumn("_k", F.lit(1)).join(F.broadcast(own.images.agg(F.count(F.lit(1)).alias("_i")).withColumn("_k", F.lit(1))), "_k").where("n > _i")),
    ]
    if other is not None:
        shared = lambda column: own.images.where(f"{column} <> ''").select(column).intersect(other.images.select(column))
        found = [(1, "subject in both splits", shared("subject_id")), (2, "content in both splits", shared("blake3_hash")), *found]
    return reduce(DataFrame.union, [_count(f, i, n) for i, n, f in found])


def manifest_checks(manifests: list[dict]) -> list[tuple[int, str, int]]:
    """Checks of the stored manifests: fingerprints' form, one fingerprint one count, builders."""
    prints: dict[str, set[int]] = {}
    for m in manifests:
        if m.get("spec_sha256"):
            prints.setdefault(m["spec_sha256"], set()).add(m["counts"]["images"])
    hexed = lambda s: len(s) == 64 and not set(s) - set("0123456789abcdef")
    return [
        (9, "fingerprint not 64 hex digits", sum(not hexed(p) for p in prints)),
        (10, "one fingerprint, several counts", sum(len(n) > 1 for n in prints.values())),
        (12, "version without builder", sum(not m.get("created_by") or "@" not in (m.get("email") or "") for m in manifests)),
    ]

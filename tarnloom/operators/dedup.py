"""Duplicate content within a candidate set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.spread import listed
from ..sources.catalog import Catalog
from ..spec import Step
from .base import Candidates, Result, dropped


def priority(sources: list[str]) -> Column:
    """Place of the set in the list; sets that are not listed come last."""
    out = F.lit(len(sources))
    for i, name in reversed(list(enumerate(sources))):
        out = F.when(F.col("original_set") == name, i).otherwise(out)
    return out


def pinned(images: DataFrame, keep: list[int]) -> DataFrame:
    """``images`` with ``_pin``, 0 for the listed ids, else null."""
    return images.join(listed(images.sparkSession, [(i, 0) for i in sorted(set(keep))], "image_id long, _pin int"), "image_id", "left")


def survivors(own: Candidates, sources: list[str], keep: list[int], prefer_annotated: bool) -> DataFrame:
    """(image_id) of images that stay: one for each hash, all without a hash.

    The best of a group is the least (pinned, annotated, source, id), found by a
    partial aggregate, so a hash that fills a third of the set is no hot window.
    """
    images = own.images.select("image_id", "blake3_hash", "original_set")
    if prefer_annotated:
        images = images.join(own.annotated().withColumn("_annotated", F.lit(0)), "image_id", "left")
    else:
        images = images.withColumn("_annotated", F.lit(0))
    images = pinned(images, keep).withColumn("_pin", F.coalesce("_pin", F.lit(1))) if keep else images.withColumn("_pin", F.lit(1))
    order = F.struct(F.col("_pin").alias("pin"), F.coalesce("_annotated", F.lit(1)).alias("bare"), priority(sources).alias("source"), F.col("image_id"))
    best = images.where("blake3_hash is not null").groupBy("blake3_hash").agg(F.min(order).alias("o")).select(F.col("o.image_id").alias("image_id"))
    return best.union(images.where("blake3_hash is null").select("image_id"))


def groups(own: Candidates) -> DataFrame:
    """(blake3_hash, members, sets): groups of two or more."""
    return own.images.where("blake3_hash is not null").groupBy("blake3_hash").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("original_set").alias("sets")).where("members > 1")


def dedup(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """One image for each content; pinned first, then annotated, then by source, then by id.

    What was dropped is never attached to the survivor. Two pins in one group
    are an error; a pin that is in no group says nothing.
    """
    own = inputs[0]
    if step["keep"]:
        pins = pinned(own.images, step["keep"]).where("_pin = 0 and blake3_hash is not null")
        torn = pins.groupBy("blake3_hash").agg(F.sort_array(F.collect_list("image_id")).alias("ids")).where(F.size("ids") > 1).orderBy("blake3_hash").take(1)
        if torn:
            raise SpecError(f"step '{step.id}': images {', '.join(map(str, torn[0]['ids']))} have one content, so only one of them can be kept")
    after = own.keep_images(survivors(own, step["source_priority"], step["keep"], step["prefer_annotated"]))

    def stats() -> dict:
        found = groups(own)
        row = found.agg(F.count(F.lit(1)), F.count_if(F.col("sets") > 1), F.sum(F.col("members") - 1)).first()
        counts, before = after.counts(), own.counts()
        manual = pinned(own.images, step["keep"]).where("_pin = 0").join(found, "blake3_hash").select("blake3_hash").distinct().count() if step["keep"] else 0
        return counts | {
            "images_before": before["images"],
            "duplicate_groups": row[0],
            "cross_source_groups": row[1],
            "dropped": row[2] or 0,
            "lost_annotations": before["cls"] + before["det"] - counts["cls"] - counts["det"],
            "no_hash": own.images.where("blake3_hash is null").count(),
            "manual_groups": manual,
        }

    return Result(after, [], stats, lambda: dropped(own, after, f"dedup:{step['key']}"))


def find_duplicates(own: Candidates) -> DataFrame:
    """(blake3_hash, image_ids, sources, labels, annotations, cross_source): groups by hash.
    Here sources are set@version. A group's ids are what the report is about."""
    notes = own.cls.select("image_id", "category").union(own.det.select("image_id", "category")).groupBy("image_id").agg(F.collect_set("category").alias("l"), F.count(F.lit(1)).alias("n"))
    shared = groups(own).select("blake3_hash")
    rows = own.images.join(shared, "blake3_hash").join(notes, "image_id", "left").withColumn("source", F.concat_ws("@", "original_set", "batch_version"))
    out = rows.groupBy("blake3_hash").agg(F.sort_array(F.collect_list("image_id")).alias("image_ids"), F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("l", F.array().cast("array<string>")))))).alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("annotations"))
    return out.withColumn("cross_source", F.size("sources") > 1)

"""Images that several annotation batches label, and rules that settle them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.spread import listed
from ..sources.catalog import Catalog
from ..spec import Step
from .base import Candidates, Result, decided

SHOWN = 100


def by_batch(own: Candidates) -> DataFrame:
    """(image_id, annotation_batch_id, source, batch_version, targets, ann_ids, annotators, max_score)
    of mapped classification annotations."""
    mapped = own.cls.join(own.targets, "category_id")
    return mapped.groupBy("image_id", "annotation_batch_id").agg(
        F.max("source").alias("source"),
        F.max("batch_version").alias("batch_version"),
        F.sort_array(F.collect_set("target")).alias("targets"),
        F.sort_array(F.collect_list("ann_id")).alias("ann_ids"),
        F.sort_array(F.collect_set("annotator")).alias("annotators"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("max_score"),
    )


def find_conflicts(own: Candidates) -> DataFrame:
    """(image_id, kind, batches, sources): images with two or more batches; kind is duplicate
    where all batches say the same, else contradiction."""
    grouped = by_batch(own).groupBy("image_id").agg(F.count(F.lit(1)).alias("batches"), F.count_distinct(F.array_join("targets", "\x1f")).alias("_kinds"), F.sort_array(F.collect_set("source")).alias("sources"))
    return grouped.where("batches > 1").select("image_id", F.when(F.col("_kinds") > 1, "contradiction").otherwise("duplicate").alias("kind"), "batches", "sources")


def _rank(values: list[str], column: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(values))):
        out = F.when(column == name, i).otherwise(out)
    return out


def _unique_least(batches: DataFrame, score: Column, name: str) -> DataFrame:
    """(image_id, name): the batch that alone has the least score of its image."""
    scored = batches.withColumn("_s", score).where("_s is not null")
    least = scored.groupBy("image_id").agg(F.min(F.struct("_s", "annotation_batch_id")).alias("a"), F.min("_s").alias("_m"))
    # the runner-up must be worse
    ties = scored.join(least.select("image_id", "_m"), "image_id").where("_s = _m").groupBy("image_id").count().where("count = 1")
    return least.join(ties.select("image_id"), "image_id", "left_semi").select("image_id", F.col("a.annotation_batch_id").alias(name))


def winners(own: Candidates, rules: list[dict], catalog: Catalog) -> DataFrame:
    """(image_id, winner, rule) for every image with two or more batches; null if no rule settles it."""
    batches = by_batch(own)
    several = find_conflicts(own).select("image_id")
    batches = batches.join(several, "image_id", "left_semi")
    out = several
    pooled = [d["keep_annotation_id"] for r in rules if r["rule"] == "manual" for d in r["decisions"]]
    order: list[tuple[str, str]] = []
    for i, rule in enumerate(rules):
        name = f"_w{i}"
        kind = rule["rule"]
        if kind == "manual":
            wanted = listed(catalog.spark, list(enumerate(pooled)), "_ordinal int, ann_id long")
            hit = batches.select("image_id", "annotation_batch_id", F.explode("ann_ids").alias("ann_id")).join(wanted, "ann_id")
            found = hit.groupBy("image_id").agg(F.min_by("annotation_batch_id", "_ordinal").alias(name))
        elif kind == "annotator_precedence":
            names = F.array(*[F.lit(a) for a in rule["annotator_precedence"]])
            places = F.transform(F.col("annotators"), lambda a: F.when(F.array_position(names, a) > 0, F.array_position(names, a)))
            found = _unique_least(batches, F.array_min(places), name)
        elif kind == "batch_version_precedence":
            found = _unique_least(batches, _rank(rule["version_precedence"], F.col("batch_version")), name)
        else:
            found = _unique_least(batches, -F.col("max_score"), name)
        out = out.join(found, "image_id", "left")
        order.append((name, kind))
    if not order:
        return out.select("image_id", F.lit(None).cast("long").alias("winner"), F.lit(None).cast("string").alias("rule"))
    return out.select("image_id", F.coalesce(*[F.col(n) for n, _ in order]).alias("winner"), F.coalesce(*[F.when(F.col(n).isNotNull(), k) for n, k in order]).alias("rule"))


def collapse(cls: DataFrame, targets: DataFrame) -> DataFrame:
    """(ann_id) that stay when each image has one annotation for a target: the highest
    score, then the lowest id. Unmapped annotations all stay."""
    mapped = cls.join(targets, "category_id")
    order = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), F.col("ann_id"))
    best = mapped.groupBy("image_id", "target").agg(F.min(order).alias("o")).select(F.col("o.ann_id").alias("ann_id"))
    return best.union(cls.join(targets, "category_id", "left_anti").select("ann_id"))


def conflict_resolve(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """Rules in order; the first that names a single batch settles an image, and the other
    batches' mapped classifications of it go. Then one annotation for a target stays on each image.

    What no rule settles is an error (strict) or stays, with a warning.
    """
    own = inputs[0]
    won = winners(own, step["rules"], catalog)
    open_ = won.where("winner is null")
    shown = [r[0] for r in open_.orderBy("image_id").limit(SHOWN).select("image_id").collect()]
    if shown and step["strict"]:
        raise SpecError(f"step '{step.id}': no rule settles {open_.count()} images, among them {', '.join(map(str, shown[:5]))}")
    settled = won.where("winner is not null")
    losers = own.cls.join(own.targets.select("category_id"), "category_id", "left_semi").join(settled, "image_id").where("annotation_batch_id <> winner")
    left = own.cls.join(losers.select("ann_id"), "ann_id", "left_anti")
    after = own.with_(cls=left.join(collapse(left, own.targets), "ann_id", "left_semi"))
    warnings = [f"{open_.count()} images are labelled by several batches and no rule settles them"] if shown else []

    def stats() -> dict:
        rules = {r[0]: r[1] for r in settled.groupBy("rule").count().collect()}
        left_count = left.count()
        multi = after.cls.join(own.targets, "category_id").groupBy("image_id").agg(F.countDistinct("target").alias("n")).where("n > 1").count()
        return after.counts() | {"conflicts": won.count(), "resolved_by_rule": rules, "unresolved": shown, "annotations_dropped": losers.count(), "collapsed": left_count - after.cls.count(), "multi_label_images": multi}

    def decisions() -> DataFrame:
        detail = F.concat(F.lit("kept batch "), F.col("winner").cast("string"))
        out = decided("cls", losers, "ann_id", "dropped", F.concat(F.lit("conflict_resolve:"), F.col("rule")), detail)
        same = left.join(after.cls.select("ann_id"), "ann_id", "left_anti")
        return out.union(decided("cls", same, "ann_id", "dropped", "conflict_resolve:same_target_duplicate"))

    return Result(after, warnings, stats, decisions)

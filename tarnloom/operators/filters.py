"""Narrowing a candidate set: annotated, sample, predicate, explicit list, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.predicate import compile_predicate
from ..functions.spread import cut, listed, ranked, scratch, small
from ..sources.catalog import Catalog
from ..sources.lists import names_frame
from ..spec import Step
from .base import Candidates, Result, bucket, dropped, subject_key
from .sources import missing


def label_context(own: Candidates) -> DataFrame:
    """(image_id, labels, targets, annotators, n_annotations) over both kinds of annotation;
    sorted distinct lists, empty for images without annotations."""
    columns = ("image_id", "category", "target", "annotator")
    every = own.mapped("cls").select(*columns).union(own.mapped("det").select(*columns))
    sets = [F.sort_array(F.collect_set(c)).alias(n) for c, n in (("category", "labels"), ("target", "targets"), ("annotator", "annotators"))]
    found = every.groupBy("image_id").agg(*sets, F.count(F.lit(1)).alias("n_annotations"))
    empty = F.array().cast("array<string>")
    return own.images.select("image_id").join(found, "image_id", "left").select("image_id", *[F.coalesce(n, empty).alias(n) for n in ("labels", "targets", "annotators")], F.coalesce("n_annotations", F.lit(0)).alias("n_annotations"))


def _result(before: Candidates, after: Candidates, reason: str, warnings: list[str] = (), more=dict, detail="") -> Result:
    stats = lambda: {"images_before": before.images.count(), **after.counts(), **more()}
    return Result(after, list(warnings), stats, lambda: dropped(before, after, reason, detail))


def filter_(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    return CRITERIA[step["criterion"]](catalog, inputs[0], step)


def annotated(catalog: Catalog, own: Candidates, step: Step) -> Result:
    return _result(own, own.keep_images(own.annotated()), "filter:annotated")


def sample_key(field: str):
    return {"subject_id": subject_key(), "image_id": F.col("image_id").cast("string"), "file_name": F.col("file_name")}[field]


def sample(catalog: Catalog, own: Candidates, step: Step) -> Result:
    """Images whose key falls into kept remainders: the same for every run, order and
    partitioning; records of one subject stay together."""
    remainder = bucket(step["seed"], sample_key(step["key_field"]), step["mod"])
    after = own.with_(images=own.images.where(remainder.isin(*step["keep_remainder"]) if step["keep_remainder"] else F.lit(False))).prune()

    def more() -> dict:
        counts = own.images.groupBy(remainder.alias("r")).count().collect()
        unknown = own.images.where(F.coalesce("subject_id", F.lit("")) == "").count() if step["key_field"] == "subject_id" else 0
        return {"remainders": {int(r[0]): r[1] for r in sorted(counts)}, "fallback_keys": unknown}

    return _result(own, after, "filter:sample", more=more)


def predicate(catalog: Catalog, own: Candidates, step: Step) -> Result:
    compiled = compile_predicate(step["expression"])
    images = own.images.join(label_context(own), "image_id") if compiled.context else own.images
    return _result(own, own.keep_images(images.where(compiled.condition)), "filter:predicate", detail=step["expression"])


def explicit_list(catalog: Catalog, own: Candidates, step: Step) -> Result:
    """Images whose file name is in the list; one name may mean several images."""
    names, total, repeats = names_frame(catalog, step["file_names"], step["file_names_ref"])
    known = small(names)
    lost = names.join(own.images.select("file_name"), "file_name", "left_anti")
    warnings = missing(lost, step, "the current set")
    after = own.with_(images=own.images.join(known, "file_name", "left_semi")).prune()
    return _result(own, after, "filter:explicit_list", warnings, lambda: {"names": total, "repeated_names": repeats, "matched_count": after.images.count(), "missing_count": lost.count()})


def classes_of(own: Candidates, by: str) -> DataFrame:
    """(image_id, class) distinct."""
    if by == "target":
        every = own.mapped("cls").select("image_id", F.col("target").alias("class")).union(own.mapped("det").select("image_id", "target"))
    else:
        every = own.cls.select("image_id", F.col("category").alias("class")).union(own.det.select("image_id", "category"))
    return every.where("class is not null").distinct()


def balance(catalog: Catalog, own: Candidates, step: Step) -> Result:
    """At most max_per_class images of each class, as far as shared images allow.

    Classes come in turn, small ones first; each takes what is kept already and
    fills up in the order of a seeded hash. Images without a class go. Classes of
    at most that many images come first and are taken whole, all in one filter. A
    turn of the others depends on the turns before, so each is a few jobs that write
    what the turn adds; its pool is numbered over partitions and never sorted in
    one task.
    """
    cap = step["max_per_class"]
    member = cut(classes_of(own, step["by"]).withColumn("_bucket", bucket(step["seed"], F.col("image_id").cast("string"), 1 << 32)), "classes")
    sizes = [(r[0], r[1]) for r in member.groupBy("class").count().orderBy("count", "class").collect()]  # the class vocabulary
    if not sizes:
        raise SpecError(f"step '{step.id}': no image has a class by {step['by']}")
    folder = scratch(catalog.spark, "kept")
    add = lambda ids, turn: ids.select("image_id").distinct().write.parquet(f"{folder}/turn={turn}")
    so_far = lambda: catalog.spark.read.schema("image_id long").parquet(folder)
    light = listed(catalog.spark, [(name,) for name, size in sizes if size <= cap], "class string")
    add(member.join(light, "class", "left_semi"), 0)
    for turn, (name, _) in enumerate([x for x in sizes if x[1] > cap], 1):
        pool, kept = member.where(F.col("class") == name), so_far()
        have = pool.join(kept, "image_id", "left_semi").count()
        rest = pool.join(kept, "image_id", "left_anti")
        if have < cap:
            add(ranked(rest.select("image_id", "_bucket", F.lit(1).alias("_k")), "_k", ["_bucket", "image_id"], "_place").where(F.col("_place") < cap - have), turn)
    kept = so_far().select("image_id")
    after = own.keep_images(kept)
    final = member.join(kept, "image_id", "left_semi").groupBy("class").count()
    over = [f"class {r[0]} has {r[1]} images, more than {cap}, through images shared with other classes" for r in final.where(F.col("count") > cap).orderBy("class").collect()]
    return _result(own, after, "filter:balance", over, lambda: {"classes_before": dict(sizes), "classes_after": {r[0]: r[1] for r in final.orderBy("class").collect()}})


CRITERIA = {"annotated": annotated, "sample": sample, "predicate": predicate, "explicit_list": explicit_list, "balance": balance}

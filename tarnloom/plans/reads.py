"""Read-side queries over the warehouse and over candidate sets or memberships.

Each gives a frame; nothing is gathered. ``members`` below are (image_id) frames
of a version, ``notes`` (ann_id, image_id, category_id, score, ...) frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spread import small
from ..operators import Candidates
from ..operators.conflicts import find_conflicts
from ..operators.sources import suffix
from ..sources.catalog import Catalog

SHOWN = 20


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _or0(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).alias(name)


# listings


def original_sets(c: Catalog) -> DataFrame:
    """(original_set, image_batches, annotation_batches, images)."""
    kinds = c.table("batches").groupBy(F.col("original_set_name").alias("original_set")).agg(
        F.countDistinct(F.when(F.col("batch_kind") == "image", F.col("batch_id"))).alias("image_batches"),
        F.countDistinct(F.when(F.col("batch_kind") == "annotation", F.col("batch_id"))).alias("annotation_batches"),
    )
    sizes = c.table("images").groupBy(F.col("image_batch_id").alias("batch_id")).agg(_n("images"))
    images = c.batches("image").join(sizes, "batch_id").groupBy("original_set").agg(F.sum("images").alias("images"))
    return kinds.join(images, "original_set", "left").select("original_set", "image_batches", "annotation_batches", _or0("images"))


def batches(c: Catalog, original_set: str | None = None) -> DataFrame:
    """(original_set, batch_kind, version, batch_id, items, categories): items are images or annotations."""
    images = c.table("images").groupBy(F.col("image_batch_id").alias("batch_id")).agg(_n("items"))
    notes = None
    for kind in ("cls", "det"):
        own = c.table(f"{kind}_annotations").select("id", F.col("annotation_batch_id").alias("batch_id")).distinct()
        part = own.groupBy("batch_id").agg(_n("items"))
        notes = part if notes is None else notes.union(part).groupBy("batch_id").agg(F.sum("items").alias("items"))
    cats = c.table("categories").groupBy(F.col("annotation_batch_id").alias("batch_id")).agg(F.countDistinct("id").alias("categories"))
    image = c.batches("image").join(images, "batch_id", "left").select("original_set", F.lit("image").alias("batch_kind"), F.col("batch_version").alias("version"), "batch_id", _or0("items"), F.lit(0).cast("long").alias("categories"))
    annotation = c.batches("annotation").join(notes, "batch_id", "left").join(cats, "batch_id", "left").select("original_set", F.lit("annotation").alias("batch_kind"), F.col("batch_version").alias("version"), "batch_id", _or0("items"), _or0("categories"))
    out = image.union(annotation)
    return out if original_set is None else out.where(F.col("original_set") == original_set)


def categories(c: Catalog, batch: int | None = None) -> DataFrame:
    out = c.categories.select("source", "category_id", "category", "supercategory", "annotation_batch_id")
    return out if batch is None else out.where(F.col("annotation_batch_id") == batch)


def annotators(c: Catalog) -> DataFrame:
    """(annotator_id, name, cls_annotations, det_annotations)."""
    out = c.table("annotators").groupBy(F.col("id").alias("annotator_id")).agg(F.min("name").alias("name"))
    for kind in ("cls", "det"):
        made = c.table(f"{kind}_annotations").select("id", "annotator_id").distinct().groupBy("annotator_id").agg(_n(f"{kind}_annotations"))
        out = out.join(made, "annotator_id", "left")
    return out.select("annotator_id", "name", _or0("cls_annotations"), _or0("det_annotations"))


# one batch


def annotation_batch_stats(c: Catalog, batch: int | None = None) -> DataFrame:
    """(annotation_batch_id, images, categories, annotators, licenses, cls, det) of each batch."""
    parts = []
    for kind in ("cls", "det"):
        own = c.table(f"{kind}_annotations").dropDuplicates(["id"])
        parts.append(own.select("annotation_batch_id", "image_id", "annotator_id", F.lit(int(kind == "cls")).alias("c"), F.lit(int(kind == "det")).alias("d")))
    rows = parts[0].union(parts[1])
    if batch is not None:
        rows = rows.where(F.col("annotation_batch_id") == batch)
    cats = c.table("categories").groupBy("annotation_batch_id").agg(F.countDistinct("id").alias("categories"))
    found = rows.groupBy("annotation_batch_id").agg(F.countDistinct("image_id").alias("images"), F.countDistinct("annotator_id").alias("annotators"), F.sum("c").alias("cls"), F.sum("d").alias("det"))
    terms = c.table("images").where("license_id is not null").select(F.col("id").alias("image_id"), "license_id")
    terms = rows.select("annotation_batch_id", "image_id").distinct().join(terms, "image_id").groupBy("annotation_batch_id").agg(F.countDistinct("license_id").alias("licenses"))
    return found.join(cats, "annotation_batch_id", "left").join(terms, "annotation_batch_id", "left").select("annotation_batch_id", "images", _or0("categories"), "annotators", _or0("licenses"), "cls", "det")


def local_distribution(c: Catalog, batch: int | None = None) -> DataFrame:
    """(category_id, positive, negative, unknown) in distinct images of the category's batch."""
    notes = c.table("cls_annotations").dropDuplicates(["id"])
    if batch is not None:
        notes = notes.where(F.col("annotation_batch_id") == batch)
    per = notes.groupBy("annotation_batch_id", "category_id").agg(
        F.countDistinct(F.when(F.col("score") > 0, F.col("image_id"))).alias("positive"), F.countDistinct(F.when(F.col("score") == 0, F.col("image_id"))).alias("negative"), F.countDistinct("image_id").alias("_any")
    )
    total = notes.groupBy("annotation_batch_id").agg(F.countDistinct("image_id").alias("_images"))
    return per.join(total, "annotation_batch_id").select("category_id", "positive", "negative", (F.col("_images") - F.col("_any")).alias("unknown"))


def image_batch_stats(c: Catalog) -> DataFrame:
    """(image_batch_id, images, with_hash, with_date, with_license, subjects)."""
    people = c.table("image_subjects").groupBy("image_id").agg(F.min("subject_id").alias("subject_id"))
    own = c.table("images").join(people, F.col("id") == F.col("image_id"), "left")
    return own.groupBy("image_batch_id").agg(_n("images"), F.count("blake3_hash").alias("with_hash"), F.count("date_captured").alias("with_date"), F.count("license_id").alias("with_license"), F.countDistinct(F.when(F.col("subject_id") != "", F.col("subject_id"))).alias("subjects"))


def suffixes(c: Catalog) -> DataFrame:
    """(image_batch_id, suffix, images)."""
    return c.table("images").groupBy("image_batch_id", suffix().alias("suffix")).agg(_n("images"))


def image_sizes(c: Catalog) -> DataFrame:
    """(image_batch_id, width, height, images)."""
    return c.table("images").groupBy("image_batch_id", "width", "height").agg(_n("images"))


def even_sample(images: DataFrame, size: int) -> DataFrame:
    """``size`` images of each batch, evenly spaced by file name: rows i * n / size.

    A batch is numbered over partitions, so its size is no limit.
    """
    from ..functions.spread import ranked

    placed = ranked(images.select("image_id", "image_batch_id", "file_name"), "image_batch_id", ["file_name", "image_id"], "_place")
    total = placed.groupBy("image_batch_id").agg(_n("_n"))
    k = F.least(F.lit(size), F.col("_n"))
    wanted = total.select("image_batch_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.floor(i * F.col("_n") / k).cast("long"))).alias("_place"))
    return placed.join(small(wanted), ["image_batch_id", "_place"]).select("image_id", "image_batch_id", "file_name")


# a version or a candidate set


def composition(own: Candidates) -> DataFrame:
    """(original_set, batch_version, images)."""
    return own.images.groupBy("original_set", "batch_version").agg(_n("images"))


def by_target(own: Candidates) -> DataFrame:
    """(target, annotations) of classifications."""
    return own.cls.join(own.targets, "category_id").groupBy("target").agg(_n("annotations"))


def subjects_summary(own: Candidates) -> DataFrame:
    """(subjects, unknown, most_per_subject): one row."""
    known = F.when(F.col("subject_id") != "", F.col("subject_id"))
    per = own.images.groupBy(known.alias("s")).agg(_n("n"))
    return per.agg(F.count("s").alias("subjects"), F.coalesce(F.sum(F.when(F.col("s").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), F.coalesce(F.max(F.when(F.col("s").isNotNull(), F.col("n"))), F.lit(0)).alias("most_per_subject"))


def target_mappings(own: Candidates) -> DataFrame:
    """(target, categories): the mapped categories in use as sorted ``source:category``, joined by |."""
    used = own.used_categories().join(own.targets, "category_id")
    return used.groupBy("target").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "source", "category"))), "|").alias("categories"))


def category_distribution(own: Candidates) -> DataFrame:
    """(target, positive, negative, unknown, boxes_positive, boxes_no_score, boxes): classifications
    in distinct images (score above 0; exactly 0; not looked for), detections in boxes."""
    total = own.images.agg(_n("_images")).withColumn("_k", F.lit(1))
    cls = own.cls.join(own.targets, "category_id").groupBy("target").agg(F.countDistinct(F.when(F.col("score") > 0, F.col("image_id"))).alias("positive"), F.countDistinct(F.when(F.col("score") == 0, F.col("image_id"))).alias("negative"), F.countDistinct("image_id").alias("_any"))
    det = own.det.join(own.targets, "category_id").groupBy("target").agg(F.count_if(F.col("score") > 0).alias("boxes_positive"), F.count_if(F.col("score").isNull()).alias("boxes_no_score"), _n("boxes"))
    names = own.targets.select("target").distinct()
    # one row on the right: a broadcast of a single number
    joined = names.withColumn("_k", F.lit(1)).join(cls, "target", "left").join(det, "target", "left").join(F.broadcast(total), "_k")
    unknown = F.greatest(F.lit(0), F.col("_images") - F.coalesce("_any", F.lit(0)))
    return joined.select("target", _or0("positive"), _or0("negative"), unknown.alias("unknown"), _or0("boxes_positive"), _or0("boxes_no_score"), _or0("boxes"))


def preview(own: Candidates) -> DataFrame:
    """(section, name, n): the summary of an exploration in one frame: images by source,
    annotations by local category, target and annotator, sizes, coverage, subjects, years."""
    images = own.images.groupBy(F.concat_ws("@", "original_set", "batch_version").alias("name")).agg(_n()).select(F.lit("source").alias("section"), "name", "n")
    notes = own.mapped("cls").select("category", "target", "annotator").union(own.mapped("det").select("category", "target", "annotator"))
    out = images
    for column, section in (("category", "local"), ("target", "target"), ("annotator", "annotator")):
        out = out.union(notes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(_n()).select(F.lit(section), "name", "n"))
    sizes = own.images.groupBy(F.concat_ws("x", "width", "height").alias("name")).agg(_n()).orderBy(F.col("n").desc(), "name").limit(5)
    covered = own.annotated().agg(_n()).select(F.lit("coverage"), F.lit("annotated"), "n")
    known = F.when(F.col("subject_id") != "", F.col("subject_id"))
    people = own.images.groupBy(known.alias("s")).agg(_n())
    most = people.where("s is not null").agg(F.count(F.lit(1)).alias("subjects"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    unknown = people.agg(F.coalesce(F.sum(F.when(F.col("s").isNull(), F.col("n"))), F.lit(0)))
    dates = own.images.groupBy(F.date_format("date_captured", "yyyy").alias("name")).agg(_n())
    unmapped = notes.where("target is null").agg(_n())
    more = [
        most.select(F.lit("subjects"), F.lit("known"), F.col("subjects")),
        most.select(F.lit("subjects"), F.lit("most images"), F.col("most")),
        unknown.select(F.lit("subjects"), F.lit("images without"), "*"),
        unmapped.select(F.lit("coverage"), F.lit("unmapped"), "n"),
        dates.select(F.lit("year"), F.coalesce("name", F.lit("none")), "n"),
    ]
    return reduce(DataFrame.union, [out, sizes.select(F.lit("size"), "name", "n"), covered, *more])


def conflict_pairs(own: Candidates) -> DataFrame:
    """(pair, kind, images): conflicts by the sources that take part, as ``a vs b``."""
    return find_conflicts(own).groupBy(F.array_join("sources", " vs ").alias("pair"), "kind").agg(_n("images"))


# comparisons


def leakage_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """(blake3_hash, left_images, right_images): content in both (image_id, blake3_hash) frames."""
    count = lambda f, n: f.where("blake3_hash is not null").groupBy("blake3_hash").agg(_n(n))
    return count(left, "left_images").join(count(right, "right_images"), "blake3_hash")


def leakage_subjects(left: DataFrame, right: DataFrame) -> DataFrame:
    """(subject_id, left_images, right_images): subjects in both (image_id, subject_id) frames."""
    count = lambda f, n: f.where("subject_id <> ''").groupBy("subject_id").agg(_n(n))
    return count(left, "left_images").join(count(right, "right_images"), "subject_id")


def shared_content(images: DataFrame) -> DataFrame:
    """(blake3_hash, versions, image_ids, subjects): content that several of any number of versions have,
    from rows (version, image_id, blake3_hash, subject_id); sorted lists, joined by comma."""
    return _shared(images.where("blake3_hash is not null"), "blake3_hash")


def shared_subjects(images: DataFrame) -> DataFrame:
    """(subject_id, versions, image_ids): subjects that several of any number of versions have."""
    return _shared(images.where("subject_id <> ''"), "subject_id").drop("subjects")


def _shared(images: DataFrame, key: str) -> DataFrame:
    # only keys of several versions gather their lists, which are the report
    several = images.groupBy(key).agg(F.countDistinct("version").alias("_v")).where("_v > 1").select(key)
    listed = lambda c, n: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(n)
    return images.join(several, key).groupBy(key).agg(listed("version", "versions"), listed("image_id", "image_ids"), listed("subject_id", "subjects"))


def diff_refs(c: Catalog, old: DataFrame, new: DataFrame, size: int = SHOWN) -> DataFrame:
    """(change, ref): the first ``size`` added and removed images as set/version/file, in order."""
    ref = F.concat_ws("/", "original_set", "batch_version", "file_name").alias("ref")
    out = None
    for change, one, other in (("added", new, old), ("removed", old, new)):
        part = one.join(other.select("image_id"), "image_id", "left_anti").select(F.lit(change).alias("change"), ref).orderBy("ref").limit(size)
        out = part if out is None else out.union(part)
    return out


def diff_ids(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(change, n): added, removed and unchanged ids."""
    both = old.select(key).distinct().withColumn("_o", F.lit(1)).join(new.select(key).distinct().withColumn("_n", F.lit(1)), key, "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("unchanged")
    return both.groupBy(change.alias("change")).agg(_n())


def diff_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, old_ids, new_ids): images of both whose classification ids differ, ids joined by comma."""
    ids = lambda f, n: f.groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_set("ann_id")), ",").alias(n))
    both = ids(old, "old_ids").join(ids(new, "new_ids"), "image_id", "full")
    return both.where(~F.coalesce("old_ids", F.lit("")).eqNullSafe(F.coalesce("new_ids", F.lit("")))).select("image_id", F.coalesce("old_ids", F.lit("")).alias("old_ids"), F.coalesce("new_ids", F.lit("")).alias("new_ids"))


def diff_mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category_id, old_target, new_target) of categories that are mapped differently."""
    both = old.select("category_id", F.col("target").alias("old_target")).join(new.select("category_id", F.col("target").alias("new_target")), "category_id", "full")
    return both.where(~F.col("old_target").eqNullSafe(F.col("new_target")))


# one image


def resolve_image(c: Catalog, name: str, lowest: bool = False) -> int:
    """The id of an image by id, by ``set/version/file`` or by file name; an ambiguous name is
    refused, or (``lowest``) means the smallest id."""
    from ..errors import SpecError

    own = c.images()
    if name.isdigit():
        rows = own.where(F.col("image_id") == int(name)).select("image_id").take(1)
    else:
        ref = F.concat_ws("/", "original_set", "batch_version", "file_name")
        rows = own.where((F.col("file_name") == name) | (ref == name)).select("image_id").orderBy("image_id").take(2)
    if not rows or (len(rows) > 1 and not lowest):
        raise SpecError(f"{name!r} " + ("means several images; give its id" if rows else "is no image"))
    return rows[0][0]


def content_twins(c: Catalog, image_id: int) -> DataFrame:
    """(image_id, source, file_name) of other images of the same content."""
    own = c.images()
    mark = own.where(F.col("image_id") == image_id).select("blake3_hash").where("blake3_hash is not null").limit(1)
    twins = own.join(F.broadcast(mark), "blake3_hash", "left_semi").where(F.col("image_id") != image_id)
    return twins.select("image_id", F.concat_ws("@", "original_set", "batch_version").alias("source"), "file_name")


def lineage(c: Catalog, image_id: int | None = None) -> DataFrame:
    """(image_id, relative_id, relation): parents and children, one step."""
    edges = c.table("image_lineage").distinct()
    out = edges.select(F.col("child_image_id").alias("image_id"), F.col("parent_image_id").alias("relative_id"), F.lit("parent").alias("relation")).union(edges.select("parent_image_id", "child_image_id", F.lit("child")))
    return out if image_id is None else out.where(F.col("image_id") == image_id)


def image_uses(store, image_id: int) -> DataFrame:
    """(version, cls, det, order): the versions that have an image and how many of its annotations,
    newest first; one scan over the memberships of all versions."""
    parts = []
    for order, m in enumerate(store.versions()):
        for part in ("images", "cls", "det"):
            rows = store.spark.read.schema("image_id long").parquet(f"{store.at(m['name'], m['version'])}/{part}").where(F.col("image_id") == image_id)
            parts.append(rows.select(F.lit(f"{m['name']}@{m['version']}").alias("version"), F.lit(order).alias("order"), F.lit(part).alias("part")))
    count = lambda part: F.count_if(F.col("part") == part)
    own = reduce(DataFrame.union, parts).groupBy("version", "order").agg(count("images").alias("_in"), count("cls").alias("cls"), count("det").alias("det"))
    return own.where("_in > 0").select("version", "cls", "det", "order")


def image_detail(c: Catalog, image_id: int, store=None) -> dict:
    """Head row, annotations, twins, relatives and the versions that use an image."""
    head = c.images().where(F.col("image_id") == image_id).first()
    used = [{"version": r["version"], "cls": r["cls"], "det": r["det"]} for r in image_uses(store, image_id).orderBy("order").collect()] if store and store.versions() else []
    return {
        "image": head.asDict() if head else None,
        "cls": [r.asDict() for r in c.annotations("cls").where(F.col("image_id") == image_id).orderBy("ann_id").collect()],
        "det": [r.asDict() for r in c.annotations("det").where(F.col("image_id") == image_id).orderBy("ann_id").collect()],
        "duplicates": [r.asDict() for r in content_twins(c, image_id).orderBy("image_id").collect()],
        "lineage": [r.asDict() for r in lineage(c, image_id).orderBy("relation", "relative_id").collect()],
        "used_by": used,
    }


def stored(c: Catalog, store, name: str, version: str) -> Candidates:
    """A published version as a candidate set."""
    at = lambda t: store.table(name, version, t)
    cls = c.annotations("cls").join(at("cls").select(F.col("cls_annotation_id").alias("ann_id")), "ann_id", "left_semi")
    det = c.annotations("det").join(at("det").select(F.col("det_annotation_id").alias("ann_id")), "ann_id", "left_semi")
    return Candidates(c.images().join(at("images"), "image_id", "left_semi"), cls, det, at("mappings"))

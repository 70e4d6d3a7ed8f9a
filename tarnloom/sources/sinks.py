"""Exports of a candidate set or published version."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.spread import cut, ranked, small
from ..operators.base import Candidates

POLYGONS = "array<array<double>>"


def polygons(column: str = "segmentation"):
    """A segmentation as a list of polygons: lists of lists as they are, a flat list wrapped,
    null for null. Run-length objects give null too; see ``unreadable``."""
    nested, flat = F.from_json(column, POLYGONS), F.from_json(column, "array<double>")
    return F.coalesce(nested, F.when(flat.isNotNull(), F.array(flat)))


def unreadable(det: DataFrame) -> DataFrame:
    """Detections whose segmentation is no polygon."""
    return det.where("segmentation is not null and trim(segmentation) <> 'null'").where(polygons().isNull())


def check_polygons(det: DataFrame) -> None:
    bad = unreadable(det).orderBy("ann_id").select("ann_id").limit(5).collect()
    if bad:
        raise SpecError(f"segmentations that are no polygons: {', '.join(str(r[0]) for r in bad)}")


def object_key():
    return F.concat_ws("/", "original_set", F.lit("images"), "batch_version", "file_name")


def image_rows(own: Candidates, licenses: DataFrame | None = None) -> DataFrame:
    """Images with their object key, and the name of their licence where a table of licences is given."""
    rows = own.images.select("image_id", object_key().alias("object_key"), "original_set", "batch_version", "file_name", "width", "height", "subject_id", "date_captured", "blake3_hash", "license_id")
    if licenses is None:
        return rows
    names = licenses.groupBy(F.col("id").alias("license_id")).agg(F.min("name").alias("license"))
    return rows.join(small(names), "license_id", "left")


def annotation_rows(own: Candidates, kind: str) -> DataFrame:
    """Annotations with their target, source and annotator; unmapped ones have a null target."""
    return own.mapped(kind)


def manifest(own: Candidates) -> DataFrame:
    """One row for each image: labels are the sorted targets of its mapped classifications,
    repeats included, joined by |; boxes count all detections."""
    labels = own.cls.join(own.targets, "category_id").groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_list("target")), "|").alias("labels"))
    boxes = own.det.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_boxes"))
    rows = image_rows(own).join(labels, "image_id", "left").join(boxes, "image_id", "left")
    return rows.select(
        "image_id", "object_key", F.col("original_set"), "batch_version", "file_name", "width", "height", "subject_id", "date_captured", "blake3_hash",
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"),
    )


def write_csv(own: Candidates, path: str) -> None:
    manifest(own).write.option("header", True).option("lineSep", "\r\n").option("nullValue", "").option("emptyValue", "").csv(path)


def numbered(own: Candidates) -> DataFrame:
    """(target, number): used targets by name, from 1."""
    used = own.used_categories().select("category_id")
    names = own.targets.join(used, "category_id", "left_semi").select("target").distinct()
    return ranked(names.withColumn("_k", F.lit(1)), "_k", ["target"], "number").select("target", (F.col("number") + 1).alias("number"))


def coco(own: Candidates) -> dict[str, DataFrame]:
    """The parts of a COCO document as frames; unmapped annotations are left out."""
    check_polygons(own.det)
    numbers = small(cut(numbered(own), "numbers"))
    images = own.images.select(F.col("image_id").alias("id"), object_key().alias("file_name"), "width", "height", F.date_format("date_captured", "yyyy-MM-dd").alias("date_captured"), F.col("license_id").alias("license"))
    det = own.mapped("det").where("target is not null").join(numbers, "target")
    box = det.select(F.col("ann_id").alias("id"), "image_id", F.col("number").alias("category_id"), "bbox", (F.col("bbox")[2] * F.col("bbox")[3]).alias("area"), F.coalesce(polygons(), F.array().cast(POLYGONS)).alias("segmentation"), F.col("iscrowd").cast("int").alias("iscrowd"), "score", "annotator")
    cls = own.mapped("cls").where("target is not null").join(numbers, "target")
    label = cls.select(F.col("ann_id").alias("id"), "image_id", F.col("number").alias("category_id"), "score", "annotator")
    return {"images": images, "categories": numbers.select(F.col("number").alias("id"), F.col("target").alias("name")), "annotations": box, "cls_annotations": label}


def write_coco_lines(own: Candidates, path: str) -> None:
    """The parts as JSON lines, written in parallel: for sets too large for one document."""
    for name, frame in coco(own).items():
        frame.write.option("ignoreNullFields", "false").json(f"{path}/{name}")


def coco_document(own: Candidates, description: str = "") -> Iterator[str]:
    """One COCO document, piece by piece; rows stream through the driver and are not held."""
    yield '{"info": ' + json.dumps({"description": description}, ensure_ascii=False)
    for name, frame in coco(own).items():
        yield f', "{name}": ['
        rows = frame.orderBy("id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()
        for i, row in enumerate(rows):
            yield (", " if i else "") + row[0]
        yield "]"
    yield "}"


def write_layout(own: Candidates, path: str) -> None:
    """Five parquet tables with ids from 1: images and annotations in the order of their ids,
    categories and annotators by name. Unmapped annotations are refused."""
    for kind in ("cls", "det"):
        if own.mapped(kind).where("target is null").take(1):
            raise SpecError(f"{kind} annotations without a target can't be exported")
    check_polygons(own.det)
    dense = lambda f, key: ranked(f.withColumn("_k", F.lit(1)), "_k", [key], "_new").drop("_k").withColumn("_new", F.col("_new") + 1)
    images = cut(dense(own.images, "image_id"), "images")
    ids = images.select("image_id", F.col("_new").alias("_image"))
    numbers = small(cut(numbered(own), "numbers"))
    names = own.cls.select("annotator").union(own.det.select("annotator")).where("annotator is not null").distinct()
    people = small(cut(dense(names, "annotator"), "people").withColumnRenamed("_new", "_person"))
    images.select(F.col("_new").alias("id"), "file_name", F.col("width").cast("long"), F.col("height").cast("long"), F.col("original_set").alias("source_dataset"), F.col("batch_version").alias("source_version")).write.parquet(f"{path}/images")
    for kind in ("cls", "det"):
        rows = dense(own.mapped(kind), "ann_id").join(ids, "image_id").join(numbers, "target").join(people, "annotator", "left")
        base = [F.col("_new").alias("id"), F.col("_image").alias("image_id"), F.col("number").alias("category_id")]
        tail = [F.col("score").cast("double"), F.col("_person").alias("annotator_id"), F.col("batch_version").alias("source_version")]
        extra = ["bbox", polygons().alias("segmentation"), F.col("iscrowd").cast("long")] if kind == "det" else []
        rows.select(*base, *extra, *tail).write.parquet(f"{path}/{kind}_annotations")
    numbers.select(F.col("number").alias("id"), F.col("target").alias("name"), F.lit(None).cast("string").alias("supercategory")).write.parquet(f"{path}/categories")
    people.select(F.col("_person").alias("id"), F.col("annotator").alias("name")).write.parquet(f"{path}/annotators")


def bundle(own: Candidates, spec_text: str, description: str = "") -> bytes:
    """A zip with the COCO document, the manifest, the specification as stored and a readme."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("coco.json", "w") as f:
            for piece in coco_document(own, description):
                f.write(piece.encode())
        rows = manifest(own).orderBy("image_id")
        with z.open("manifest.csv", "w") as f:
            import csv

            text = io.TextIOWrapper(f, "utf-8", newline="")
            writer = csv.writer(text)
            writer.writerow(rows.columns)
            for r in rows.toLocalIterator():
                writer.writerow(["" if v is None else v for v in r])
            text.detach()
        z.writestr("spec.yaml", spec_text)
        z.writestr("README.txt", f"{description}\ncoco.json: COCO document\nmanifest.csv: one row for each image\nspec.yaml: how the set was built\n")
    return out.getvalue()

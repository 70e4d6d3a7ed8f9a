"""Leaves: whole batches and name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..sources.catalog import Catalog
from ..sources.lists import names_frame
from ..spec import Step
from .base import TARGETS, Candidates, Result

MISSING_SHOWN = 200


def _no_targets(catalog: Catalog) -> DataFrame:
    return catalog.nothing(TARGETS)


def _around(catalog: Catalog, images: DataFrame, ids: DataFrame, with_annotations: bool) -> Candidates:
    if with_annotations:
        cls, det = catalog.annotations("cls", on=ids), catalog.annotations("det", on=ids)
    else:
        cls, det = catalog.annotations("cls").limit(0), catalog.annotations("det").limit(0)
    return Candidates(images, cls, det, _no_targets(catalog))


def image_batches(catalog: Catalog, batches: list[int], with_annotations: bool) -> Candidates:
    """Whole image batches, with what labels their images have in any batch, in one scan."""
    return _around(catalog, catalog.images(*batches), catalog.image_ids(*batches), with_annotations)


def source(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """A whole batch: an image batch with what labels its images have in any batch, or an
    annotation batch with the images it refers to."""
    if step["image_batch"] is not None:
        batch = catalog.batch_id("image", step["original_set"], step["image_batch"])
        own = image_batches(catalog, [batch], step["with_annotations"])
    else:
        batch = catalog.batch_id("annotation", step["original_set"], step["annotation_batch"])
        cls, det = catalog.annotations("cls", batch), catalog.annotations("det", batch)
        ids = cls.select("image_id").union(det.select("image_id")).distinct()
        own = Candidates(catalog.images().join(ids, "image_id", "left_semi"), cls, det, _no_targets(catalog))

    def stats() -> dict:
        bare = own.images.join(own.annotated(), "image_id", "left_anti").count()
        return own.counts() | {"sources": sorted(r[0] for r in own.cls.select("source").union(own.det.select("source")).distinct().collect()), "categories": own.used_categories().count(), "unannotated_images": bare}

    return Result(own, [], stats)


def import_list(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """The images of one batch that a name list holds, by exact file name."""
    batch = catalog.batch_id("image", step["original_set"], step["image_batch"])
    names, total, repeats = names_frame(catalog, step["file_names"], step["file_names_ref"])
    every = catalog.images(batch)
    images = every.join(names, "file_name", "left_semi")
    lost = names.join(every.select("file_name"), "file_name", "left_anti")
    warnings = missing(lost, step, f"{step['original_set']}@{step['image_batch']}")
    own = _around(catalog, images, images, step["with_annotations"])

    def stats() -> dict:
        return own.counts() | {"names": total, "repeated_names": repeats, "matched_count": names.join(every.select("file_name"), "file_name", "left_semi").count(), "missing_count": lost.count()}

    return Result(own, warnings, stats)


def missing(lost: DataFrame, step: Step, where: str) -> list[str]:
    """Applies on_missing; the message names the first missing ones in order."""
    if step["on_missing"] == "ignore":
        return []
    shown = [r[0] for r in lost.orderBy("file_name").limit(MISSING_SHOWN).collect()]
    if not shown:
        return []
    message = f"step '{step.id}': {lost.count()} names are not in {where}: {', '.join(shown[:5])}"
    if step["on_missing"] == "error":
        raise SpecError(message)
    return [message]


def suffix():
    """Lower-case file suffix, ``(none)`` without one."""
    found = F.lower(F.regexp_extract("file_name", r"(?<=[^/])(\.[^./]+)$", 1))
    return F.when(found == "", "(none)").otherwise(found)

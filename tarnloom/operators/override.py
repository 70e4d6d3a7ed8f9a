"""Manual inclusion and exclusion, in the order given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.spread import listed
from ..sources.catalog import Catalog
from ..spec import Step
from .base import DECISION, Candidates, Result


def manual_override(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """Overrides are few: what they name is fetched, played through in order on the
    driver, and the net change is applied to the frames."""
    own = inputs[0]
    spark = catalog.spark
    todo = step["overrides"]
    if not todo:
        return Result(own, [], own.counts)
    image_ids = sorted({o["image_id"] for o in todo if o["image_id"] is not None})
    ann_ids = {k: sorted({o["annotation_id"] for o in todo if o["annotation_id"] is not None and o["annotation_kind"] == k}) for k in ("cls", "det")}
    frame = lambda ids, name: listed(spark, [(i,) for i in ids], f"{name} long")

    # what the named records are, and whether they are in the set
    home: dict[str, dict[int, int]] = {}
    inside: dict[str, set[int]] = {}
    for kind in ("cls", "det"):
        every = catalog.table(f"{kind}_annotations").select(F.col("id").alias("ann_id"), "image_id").distinct()
        named = every.join(frame(ann_ids[kind], "ann_id"), "ann_id", "left_semi").unionByName(every.join(frame(image_ids, "image_id"), "image_id", "left_semi")).select("ann_id", "image_id").distinct()
        home[kind] = {r[0]: r[1] for r in named.collect()}
        inside[kind] = {r[0] for r in getattr(own, kind).join(frame(home[kind], "ann_id"), "ann_id", "left_semi").select("ann_id").collect()}
    wanted = sorted({*image_ids, *(i for h in home.values() for i in h.values())})
    exists = {r[0] for r in catalog.table("images").select(F.col("id").alias("image_id")).join(frame(wanted, "image_id"), "image_id", "left_semi").collect()}
    images = {r[0] for r in own.images.join(frame(wanted, "image_id"), "image_id", "left_semi").select("image_id").collect()}

    start_images, start = set(images), {k: set(v) for k, v in inside.items()}
    failures, reasons = [], {}

    def play(o: dict) -> str | None:
        kind, image, ann = o["annotation_kind"], o["image_id"], o["annotation_id"]
        reason = f"manual_override:{o['reason'] or o['action']}"
        if o["action"] == "exclude_image":
            if image not in exists:
                return f"image {image} does not exist"
            if image not in images:
                return f"image {image} is not in the set"
            images.discard(image)
            reasons["image", image] = reason
            for k in ("cls", "det"):
                for a, i in home[k].items():
                    if i == image and a in inside[k]:
                        inside[k].discard(a)
                        reasons[k, a] = reason
        elif o["action"] == "include_image":
            if image not in exists:
                return f"image {image} does not exist"
            if image in images:
                return f"image {image} is in the set already"
            images.add(image)
            reasons["image", image] = reason
            for k in ("cls", "det"):
                for a, i in home[k].items():
                    if i == image:
                        inside[k].add(a)
                        reasons[k, a] = reason
        elif o["action"] == "exclude_annotation":
            if ann not in inside[kind]:
                return f"{kind} annotation {ann} is not in the set"
            inside[kind].discard(ann)
            reasons[kind, ann] = reason
        else:
            if ann not in home[kind]:
                return f"{kind} annotation {ann} does not exist"
            if home[kind][ann] not in images:
                return f"the image of {kind} annotation {ann} is not in the set"
            if ann in inside[kind]:
                return f"{kind} annotation {ann} is in the set already"
            inside[kind].add(ann)
            reasons[kind, ann] = reason
        return None

    for o in todo:
        if (said := play(o)) is not None:
            failures.append(said)
    if failures:
        raise SpecError(f"step '{step.id}': " + "; ".join(failures))

    def change(part: DataFrame, key: str, before: set[int], after: set[int], every: DataFrame) -> DataFrame:
        gone, came = before - after, after - before
        if gone:
            part = part.join(frame(sorted(gone), key), key, "left_anti")
        if came:
            part = part.unionByName(every.join(frame(sorted(came), key), key, "left_semi"))
        return part

    after = own.with_(
        images=change(own.images, "image_id", start_images, images, catalog.images()),
        cls=change(own.cls, "ann_id", start["cls"], inside["cls"], catalog.annotations("cls")),
        det=change(own.det, "ann_id", start["det"], inside["det"], catalog.annotations("det")),
    ).prune()
    if any(o["action"] == "exclude_annotation" for o in todo):
        bare = after.images.join(after.annotated(), "image_id", "left_anti").orderBy("image_id").select("image_id").limit(5).collect()
        if bare:
            raise SpecError(f"step '{step.id}': images without any annotation: {', '.join(str(r[0]) for r in bare)}")

    def decisions() -> DataFrame:
        rows = [(k, i, "added" if (i in (images if k == "image" else inside[k])) else "dropped", r, "") for (k, i), r in sorted(reasons.items())]
        return spark.createDataFrame(rows, DECISION)

    return Result(after, [], lambda: after.counts() | {"overrides": len(todo)}, decisions)

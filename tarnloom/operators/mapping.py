"""Local categories to one target vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.spread import listed
from ..sources.catalog import Catalog
from ..spec import Step
from .base import Candidates, Result, decided

SHOWN = 50


def category_map(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """Targets for the categories in use: inherited ones, then (merge_identical) a category's
    own name where there is none, then the explicit mapping over both.

    An unmapped category is an error (require_total), or its annotations go while
    the images stay (drop_unmapped), or it is left for later.
    """
    own = inputs[0]
    spark = catalog.spark
    present = own.used_categories()
    rows = [(scope, local, target) for scope, names in step["mapping"].items() for local, target in names.items()]
    explicit = listed(spark, rows, "source string, category string, given string")
    known = present.join(own.targets, "category_id", "left").join(explicit, ["source", "category"], "left")
    merged = F.coalesce("given", "target", F.col("category") if step["merge_identical"] else F.lit(None).cast("string"))
    resolved = known.select("category_id", "source", "category", F.col("target").alias("inherited"), merged.alias("target"))
    targets = resolved.where("target is not null").select("category_id", "target")
    # categories that are mapped but not in use keep what they have
    targets = targets.union(own.targets.join(present, "category_id", "left_anti"))

    unmapped = resolved.where("target is null")
    refs = unmapped.select(F.concat_ws(":", "source", "category").alias("ref"))
    if step["require_total"]:
        shown = [r[0] for r in refs.orderBy("ref").limit(SHOWN).collect()]
        if shown:
            raise SpecError(f"step '{step.id}': unmapped categories: {', '.join(shown)}")
    after = own.with_(targets=targets)
    if step["drop_unmapped"]:
        ids = targets.select("category_id")
        after = after.with_(cls=own.cls.join(ids, "category_id", "left_semi"), det=own.det.join(ids, "category_id", "left_semi"))

    warnings: list[str] = []
    if rows:
        sources = {r[0] for r in catalog.categories.join(explicit.select("source").distinct(), "source", "left_semi").select("source").distinct().collect()}
        warnings += [f"mapping scope {s} is no annotation batch" for s in sorted(set(step["mapping"]) - sources)]
        absent = explicit.join(catalog.categories, ["source", "category"], "left_anti").orderBy("source", "category")
        warnings += [f"mapping {r[0]}:{r[1]} is no category" for r in absent.select("source", "category").collect()]

    def stats() -> dict:
        used = {r[0] for r in resolved.select("target").distinct().collect()}
        return after.counts() | {
            "mapped": resolved.where("target is not null").count(),
            "unmapped": [r[0] for r in refs.orderBy("ref").limit(SHOWN).collect()],
            "targets_without_source": sorted({r[2] for r in rows} - used),
        }

    def decisions() -> DataFrame:
        changed = resolved.where("inherited is not null and target is not null and inherited <> target")
        out = decided("category", changed, "category_id", "remapped", "category_map", F.concat(F.col("inherited"), F.lit(" -> "), F.col("target")))
        for kind in ("cls", "det"):
            gone = getattr(own, kind).join(getattr(after, kind).select("ann_id"), "ann_id", "left_anti")
            out = out.union(decided(kind, gone, "ann_id", "dropped", "category_map:unmapped"))
        return out

    return Result(after, warnings, stats, decisions)


def category_report(own: Candidates) -> DataFrame:
    """(source, category, target, annotations): use of each category; target null if unmapped."""
    every = own.mapped("cls").select("source", "category", "target").union(own.mapped("det").select("source", "category", "target"))
    return every.groupBy("source", "category", "target").agg(F.count(F.lit(1)).alias("annotations"))

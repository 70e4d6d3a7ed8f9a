"""Set algebra over candidate sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..sources.catalog import Catalog
from ..spec import Step
from .base import Candidates, Result, decided


def merge_targets(inputs: list[Candidates], step: Step) -> DataFrame:
    """One target for each category; two different ones are an error."""
    given = [c.targets for c in inputs if not c.targets.isEmpty()]
    if len(given) < 2:
        return given[0] if given else inputs[0].targets
    every = reduce(DataFrame.union, given).distinct()
    torn = every.groupBy("category_id").agg(F.sort_array(F.collect_set("target")).alias("t")).where(F.size("t") > 1).orderBy("category_id").limit(5).collect()
    if torn:
        raise SpecError(f"step '{step.id}': categories with several targets: " + "; ".join(f"{r[0]}: {', '.join(r[1])}" for r in torn))
    return every


def _each(inputs: list[Candidates]) -> list[dict[str, int]]:
    return [c.counts() for c in inputs]


def union(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    targets = merge_targets(inputs, step)
    join = lambda part, key: reduce(DataFrame.unionByName, [getattr(c, part) for c in inputs]).dropDuplicates([key])
    own = Candidates(join("images", "image_id"), join("cls", "ann_id"), join("det", "ann_id"), targets)

    def stats() -> dict:
        common = reduce(lambda a, b: a.join(b, "image_id", "left_semi"), [c.images.select("image_id") for c in inputs])
        return own.counts() | {"inputs": _each(inputs), "image_overlap": common.count() if len(inputs) > 1 else 0}

    return Result(own, [], stats)


def intersect(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """What all inputs hold, by id, for images and for each kind of annotation."""
    targets = merge_targets(inputs, step)
    meet = lambda part, key: reduce(lambda a, b: a.join(getattr(b, part).select(key), key, "left_semi"), inputs[1:], getattr(inputs[0], part))
    own = Candidates(meet("images", "image_id"), meet("cls", "ann_id"), meet("det", "ann_id"), targets).prune()
    return Result(own, [], lambda: own.counts() | {"inputs": _each(inputs)})


def except_(catalog: Catalog, inputs: list[Candidates], step: Step) -> Result:
    """The first input without the others; only its targets stay."""
    first, rest = inputs[0], inputs[1:]
    minus = lambda part, key: reduce(lambda a, b: a.join(getattr(b, part).select(key), key, "left_anti"), rest, getattr(first, part))
    own = Candidates(minus("images", "image_id"), minus("cls", "ann_id"), minus("det", "ann_id"), first.targets).prune()

    def decisions() -> DataFrame:
        gone = first.images.join(own.images.select("image_id"), "image_id", "left_anti")
        return decided("image", gone, "image_id", "dropped", "except")

    return Result(own, [], lambda: own.counts() | {"inputs": _each(inputs)}, decisions)

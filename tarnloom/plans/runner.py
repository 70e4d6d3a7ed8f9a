"""Evaluation of a specification, and the trail of one image through it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.spread import cut
from ..operators import OPERATORS, Candidates, Result
from ..operators.base import DECISION
from ..operators.sources import image_batches
from ..sources.catalog import Catalog
from ..spec import Spec, Step

@dataclass
class Run:
    spec: Spec
    results: dict[str, Result]

    @property
    def final(self) -> Candidates:
        return self.results[self.spec.final].candidates

    @property
    def warnings(self) -> list[str]:
        return [f"{k}: {w}" for k in (s.id for s in self.spec.steps) if k in self.results for w in self.results[k].warnings]


PARTS = ("images", "cls", "det", "targets")
#: Steps that shuffle whole parts, steps that read their input many times, and steps that read it once.
WIDE = {"union", "dedup", "conflict_resolve"}
GREEDY = {"dedup", "conflict_resolve"}
ONCE = {"union"}


class Results(dict):
    """Results by step; some are made when they are asked for."""

    def __init__(self):
        super().__init__()
        self.later: dict[str, Callable[[], Result]] = {}

    def __missing__(self, key: str) -> Result:
        self[key] = self.later[key]()
        return self[key]


def kind_of(step: Step) -> str:
    return f"filter.{step['criterion']}" if step.op == "filter" else step.op


def step_result(catalog: Catalog, step: Step, inputs: list[Candidates], write: bool = True, whole: bool = True) -> Result:
    """Applies a step; with ``write``, its candidate set goes to the shared folder, without
    ``whole`` only its images where the annotations it chooses from are there already.

    What is written is the narrow candidate set; parts that an input already has, and
    detections where the catalog has none, are not written, and the parts are written
    side by side.
    """
    result = OPERATORS[step.op](catalog, inputs, step)
    own = result.candidates
    if "det_annotations" not in catalog.tables:
        det = _no_boxes(catalog)
        own = replace(own, det=det, base=own.base and (own.base[0], det))
    result.candidates = own
    return cut_result(catalog, result, inputs, whole) if write else result


def _no_boxes(catalog: Catalog) -> DataFrame:
    kinds = dict(catalog.annotations("det").dtypes)
    return catalog.nothing(", ".join(f"{n} {k}" for n, k in kinds.items()))


def cut_result(catalog: Catalog, result: Result, inputs: list[Candidates] = (), whole: bool = True) -> Result:
    own = result.candidates
    there = {id(f) for f in [*catalog._nothing.values(), *catalog.written]}
    known = there | {id(getattr(i, p)) for i in inputs for p in PARTS}
    chosen = not whole and own.base is not None and all(id(f) in there for f in own.base)
    todo = [p for p in (("images", "targets") if chosen else PARTS) if id(getattr(own, p)) not in known]
    with ThreadPoolExecutor(len(PARTS)) as pool:
        cuts = {p: pool.submit(cut, getattr(own, p), p) for p in todo}
    made = {p: f.result() for p, f in cuts.items()}
    catalog.written += made.values()
    result.candidates = own.with_(**made).prune() if chosen else own.with_(**made)
    return result


def written(spec: Spec) -> set[str]:
    """Steps whose candidate sets are written: those that several steps use, those that a step
    reads many times, and shuffled ones that are read more than once. Others stay lazy, so
    their filters reach the scans."""
    users: dict[str, list[Step]] = {s.id: [] for s in spec.steps}
    for s in spec.steps:
        for i in s.inputs:
            users[i].append(s)
    out = set()
    for s in spec.steps:
        own = users[s.id]
        many = len(own) > 1 or any(u.op in GREEDY or kind_of(u) == "filter.balance" for u in own)
        if many or (s.op in WIDE and any(u.op not in ONCE for u in own)):
            out.add(s.id)
    return out


def fused(catalog: Catalog, spec: Spec) -> dict[str, list[int]]:
    """Unions of whole image batches that nothing else uses, with the ids of the batches: one
    scan instead of one for each batch. The batches must exist and be different."""
    by = {s.id: s for s in spec.steps}
    used = [i for s in spec.steps for i in s.inputs] + [spec.final]
    out = {}
    for s in spec.steps:
        given = [by[i] for i in s.inputs]
        if s.op == "union" and all(g.op == "source" and g["image_batch"] is not None and g["with_annotations"] == given[0]["with_annotations"] and used.count(g.id) == 1 for g in given):
            out[s.id] = [catalog.batch_id("image", g["original_set"], g["image_batch"]) for g in given]
    return out


def run(catalog: Catalog, spec: Spec, keep_final: bool = False) -> Run:
    """All declared steps in order, also those that ``final`` does not reach: their errors count.
    With ``keep_final`` the final set is written as well, for callers that read it often."""
    results, kept, whole = Results(), written(spec), fused(catalog, spec)
    leaves = {i for s in spec.steps if s.id in whole for i in s.inputs}
    if keep_final:
        kept.add(spec.final)
    for s in spec.steps:
        if s.id in leaves:
            results.later[s.id] = lambda s=s: step_result(catalog, s, [], write=False)
        elif s.id in whole:
            own = image_batches(catalog, whole[s.id], next(x for x in spec.steps if x.id == s.inputs[0])["with_annotations"])
            result = Result(own, [], lambda s=s: OPERATORS["union"](catalog, [results[i].candidates for i in s.inputs], s).stats)
            results[s.id] = cut_result(catalog, result) if s.id in kept else result
        else:
            many = keep_final and s.id == spec.final or any(u.op == "conflict_resolve" and s.id in u.inputs for u in spec.steps)
            results[s.id] = step_result(catalog, s, [results[i].candidates for i in s.inputs], s.id in kept, many)
    return Run(spec, results)


def check(own: Candidates) -> None:
    """What a published set must satisfy: every annotation has a target, every image an annotation.
    An empty set satisfies both."""
    for kind in ("cls", "det"):
        bare = getattr(own, kind).join(own.targets, "category_id", "left_anti").orderBy("ann_id").select("ann_id").limit(5).collect()
        if bare:
            raise SpecError(f"{kind} annotations without a target: {', '.join(str(r[0]) for r in bare)}")
    bare = own.images.join(own.annotated(), "image_id", "left_anti").orderBy("image_id").select("image_id").limit(5).collect()
    if bare:
        raise SpecError(f"images without any annotation: {', '.join(str(r[0]) for r in bare)}")


def explain(done: Run, image_id: int) -> DataFrame:
    """(step, op, entity_kind, entity_id, decision, reason, detail): where an image and its
    annotations came in or went, and remappings of its categories, in step order.

    Membership in any input is compared with the output; a step without
    inputs adds what it has. Where an operator gives no reason, its name is it.
    """
    spark = done.final.images.sparkSession
    trail = spark.createDataFrame([], f"n int, step string, op string, {DECISION}")
    every = [done.results[s.id].candidates for s in done.spec.steps]
    own = {k: [getattr(c, k).where(F.col("image_id") == image_id) for c in every] for k in ("cls", "det")}
    cats = None
    for frames in own.values():
        for f in frames:
            part = f.select("category_id")
            cats = part if cats is None else cats.union(part)
    cats = cats.distinct()
    for n, s in enumerate(done.spec.steps):
        result = done.results[s.id]
        given = [done.results[i].candidates for i in s.inputs]
        said = result.decisions
        for kind, part, key in (("image", "images", "image_id"), ("cls", "cls", "ann_id"), ("det", "det", "ann_id")):
            pick = lambda c: getattr(c, part).where(F.col("image_id") == image_id).select(F.col(key).alias("entity_id"))  # noqa: E731, B023
            before = spark.createDataFrame([], "entity_id long")
            for c in given:
                before = before.union(pick(c))
            after = pick(result.candidates)
            came = after.join(before.distinct(), "entity_id", "left_anti").withColumn("decision", F.lit("added"))
            went = before.distinct().join(after, "entity_id", "left_anti").withColumn("decision", F.lit("dropped"))
            rows = came.union(went).withColumn("entity_kind", F.lit(kind))
            if said is not None:
                rows = rows.join(said.select("entity_kind", "entity_id", "decision", "reason", "detail").dropDuplicates(["entity_kind", "entity_id", "decision"]), ["entity_kind", "entity_id", "decision"], "left")
            else:
                rows = rows.withColumn("reason", F.lit(None).cast("string")).withColumn("detail", F.lit(""))
            trail = trail.unionByName(rows.select(F.lit(n).alias("n"), F.lit(s.id).alias("step"), F.lit(s.op).alias("op"), "entity_kind", "entity_id", "decision", F.coalesce("reason", F.lit(s.op)).alias("reason"), F.coalesce("detail", F.lit("")).alias("detail")))
        if said is not None:
            remaps = said.where("entity_kind = 'category'").join(cats.select(F.col("category_id").alias("entity_id")), "entity_id", "left_semi")
            trail = trail.unionByName(remaps.select(F.lit(n).alias("n"), F.lit(s.id).alias("step"), F.lit(s.op).alias("op"), "entity_kind", "entity_id", "decision", "reason", "detail"))
    return trail.orderBy("n", "entity_kind", "entity_id").drop("n")

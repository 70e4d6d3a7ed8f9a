"""Interactive exploration: steps are applied as they are given, and compiled into a specification.

Every source opens a branch; open branches are steps that nothing consumes. A
step that fails leaves everything as it was.
"""

from __future__ import annotations

from typing import Any

from ..errors import SpecError
from ..operators import Candidates, Result
from ..operators.conflicts import find_conflicts
from ..operators.dedup import find_duplicates
from ..operators.mapping import category_report
from ..sources import lists
from ..sources.catalog import Catalog
from ..spec import Spec, Step
from . import reads
from .publish import Author, Store, build
from .runner import step_result


class Session:
    def __init__(self, catalog: Catalog, lists_path: str | None = None, on_warning=None):
        self.catalog, self.lists_path, self.on_warning = catalog, lists_path, on_warning or (lambda message: None)
        self.steps: list[Step] = []
        self.results: dict[str, Result] = {}
        self.head: str | None = None
        self.marks: dict[str, tuple[int, str | None]] = {}
        self.made: dict[str, int] = {}

    # state

    @property
    def current(self) -> Candidates:
        if self.head is None:
            raise SpecError("nothing is loaded yet; add a source")
        return self.results[self.head].candidates

    @property
    def open_branches(self) -> list[str]:
        used = {i for s in self.steps for i in s.inputs}
        return [s.id for s in self.steps if s.id not in used]

    def _name(self, op: str) -> str:
        taken = {s.id for s in self.steps}
        while True:
            self.made[op] = self.made.get(op, 0) + 1
            if (name := f"{op}_{self.made[op]}") not in taken:
                return name

    def _apply(self, op: str, **params: Any) -> Result:
        step = Step.parse({"id": self._name(op), "op": op, **{k: v for k, v in params.items() if v is not None}})
        inputs = [self.results[i].candidates for i in step.inputs]
        result = step_result(self.catalog, step, inputs)
        self.steps.append(step)
        self.results[step.id] = result
        self.head = step.id
        for w in result.warnings:
            self.on_warning(w)
        return result

    def _on_head(self, op: str, **params: Any) -> Result:
        if self.head is None:
            raise SpecError("nothing is loaded yet; add a source")
        return self._apply(op, input=self.head, **params)

    def _names(self, names: list[str], source: str | None) -> dict[str, Any]:
        """Short lists go into the step, long ones are stored and referred to."""
        own = lists.tidy(names)
        if len(own) <= lists.INLINE_MOST or self.lists_path is None:
            return {"file_names": own}
        key = lists.register(self.catalog.spark, self.lists_path, own, source)
        self.catalog.tables["import_lists"] = self.catalog.spark.read.parquet(self.lists_path)
        return {"file_names_ref": {"sha256": key, **({"source": source} if source else {})}}

    # sources and sets

    def add_source(self, original_set: str, image_batch: str | None = None, annotation_batch: str | None = None, with_annotations: bool = True) -> Result:
        return self._apply("source", original_set=original_set, image_batch=image_batch, annotation_batch=annotation_batch, with_annotations=with_annotations)

    def import_list(self, original_set: str, image_batch: str, names: list[str], source: str | None = None, on_missing: str = "error") -> Result:
        return self._apply("import_list", original_set=original_set, image_batch=image_batch, on_missing=on_missing, **self._names(names, source))

    def last_import_report(self) -> dict[str, Any]:
        for s in reversed(self.steps):
            if s.op == "import_list":
                return self.results[s.id].stats
        raise SpecError("no list was imported")

    def _combine(self, op: str, inputs: list[str] | None) -> Result:
        """Over the given steps, or all open branches."""
        chosen = inputs or self.open_branches
        if len(chosen) < 2:
            raise SpecError(f"{op} needs at least two " + ("inputs" if inputs else "open branches"))
        if unknown := [i for i in chosen if i not in self.results]:
            raise SpecError(f"no step {unknown[0]!r}")
        return self._apply(op, inputs=chosen)

    def union(self, inputs: list[str] | None = None) -> Result:
        return self._combine("union", inputs)

    def intersect(self, inputs: list[str] | None = None) -> Result:
        return self._combine("intersect", inputs)

    def exclude(self, inputs: list[str] | None = None) -> Result:
        return self._combine("except", inputs)

    # narrowing

    def filter(self, expression: str) -> Result:
        return self._on_head("filter", criterion="predicate", expression=expression)

    def pick(self, names: list[str], source: str | None = None, on_missing: str = "warn") -> Result:
        return self._on_head("filter", criterion="explicit_list", on_missing=on_missing, **self._names(names, source))

    def split(self, mod: int, keep_remainder: list[int], seed: str, key_field: str = "subject_id") -> Result:
        return self._on_head("filter", criterion="sample", mod=mod, keep_remainder=keep_remainder, seed=seed, key_field=key_field)

    def balance(self, max_per_class: int, seed: str, by: str = "target") -> Result:
        return self._on_head("filter", criterion="balance", max_per_class=max_per_class, seed=seed, by=by)

    def keep_annotated_only(self) -> Result:
        return self._on_head("filter", criterion="annotated")

    def find_duplicates(self):
        return find_duplicates(self.current)

    def dedup(self, source_priority: list[str] | None = None, keep: list[int] | None = None, prefer_annotated: bool = True) -> Result:
        return self._on_head("dedup", source_priority=source_priority or [], keep=keep or [], prefer_annotated=prefer_annotated)

    # categories and conflicts; exploration is permissive, compile() tightens

    def map_category(self, mapping: dict[str, dict[str, str]]) -> Result:
        return self._on_head("category_map", mapping=mapping, require_total=False, drop_unmapped=False)

    def merge_identical_category(self) -> Result:
        return self._on_head("category_map", merge_identical=True, require_total=False, drop_unmapped=False)

    def preview_categories(self):
        return category_report(self.current)

    def find_conflicts(self):
        return find_conflicts(self.current)

    unresolved_conflicts = find_conflicts

    def conflict_summary(self):
        return reads.conflict_pairs(self.current)

    def _resolve(self, rule: dict[str, Any]) -> Result:
        return self._on_head("conflict_resolve", rules=[rule], strict=False)

    def resolve_by_annotator(self, order: list[str]) -> Result:
        return self._resolve({"rule": "annotator_precedence", "annotator_precedence": order})

    def resolve_by_version(self, order: list[str]) -> Result:
        return self._resolve({"rule": "batch_version_precedence", "version_precedence": order})

    def resolve_by_score(self) -> Result:
        return self._resolve({"rule": "highest_score"})

    def resolve_manual(self, keep: dict[int, str]) -> Result:
        return self._resolve({"rule": "manual", "decisions": [{"keep_annotation_id": i, "reason": r} for i, r in keep.items()]})

    # overrides

    def override(self, overrides: list[dict[str, Any]]) -> Result:
        return self._on_head("manual_override", overrides=overrides)

    def override_one(self, action: str, **params: Any) -> Result:
        return self.override([{"action": action, **params}])

    def exclude_image(self, image_id: int, reason: str = "") -> Result:
        return self.override_one("exclude_image", image_id=image_id, reason=reason)

    def preview(self):
        return reads.preview(self.current)

    def preview_delta(self) -> dict[str, int]:
        """Counts now less those of the first input of the last declared step."""
        now = self.current.counts()
        before = self.results[self.steps[-1].inputs[0]].candidates.counts() if self.steps and self.steps[-1].inputs else dict.fromkeys(now, 0)
        return {k: now[k] - before[k] for k in now}

    # history

    def checkpoint(self, name: str) -> None:
        self.marks[name] = (len(self.steps), self.head)

    def rollback(self, name: str) -> None:
        if name not in self.marks:
            raise SpecError(f"no checkpoint {name!r}")
        length, head = self.marks[name]
        for s in self.steps[length:]:
            self.results.pop(s.id)
        del self.steps[length:]
        self.head = head
        self.marks = {k: v for k, v in self.marks.items() if v[0] <= length}

    def checkout(self, step_id: str) -> None:
        if step_id not in self.results:
            raise SpecError(f"no step {step_id!r}")
        self.head = step_id

    def undo(self) -> None:
        """Removes the head step; refused while another step reads it."""
        if self.head is None:
            raise SpecError("nothing to undo")
        if users := [s.id for s in self.steps if self.head in s.inputs]:
            raise SpecError(f"step {self.head} is used by {', '.join(users)}")
        step = next(s for s in self.steps if s.id == self.head)
        self.steps.remove(step)
        self.results.pop(step.id)
        self.marks = {k: v for k, v in self.marks.items() if v[0] <= len(self.steps)}
        self.head = step.inputs[0] if step.inputs else (self.steps[-1].id if self.steps else None)

    # compile

    def compile(self, description: str | None = None) -> Spec:
        """The steps as a specification: open branches are united, the last conflict_resolve
        becomes strict and the last category_map total."""
        if not self.steps:
            raise SpecError("nothing to compile")
        plain = [s.plain() for s in self.steps]
        branches = self.open_branches
        final = branches[0]
        if len(branches) > 1:
            final = "auto_union_final"
            plain.append({"id": final, "op": "union", "inputs": branches})
        for op, tight in (("conflict_resolve", {"strict": True}), ("category_map", {"require_total": True, "drop_unmapped": True})):
            for s in reversed(plain):
                if s["op"] == op:
                    s.update(tight)
                    break
        return Spec.parse({"description": description, "steps": plain, "final": final})

    def commit(self, store: Store, name: str, version: str, author: Author, description: str | None = None, **kwargs: Any):
        return build(self.catalog, store, self.compile(description), name, version, author, **kwargs)

    def replay(self, spec: Spec) -> None:
        """Loads a specification's steps into an empty session."""
        if self.steps:
            raise SpecError("a specification is loaded into an empty session only")
        for s in spec.steps:
            self.results[s.id] = step_result(self.catalog, s, [self.results[i].candidates for i in s.inputs])
            self.steps.append(s)
            self.made[s.op] = self.made.get(s.op, 0) + 1
        self.head = spec.final

    def describe(self) -> list[str]:
        open_ = set(self.open_branches)
        return [f"{'*' if s.id == self.head else ' '} {s.id} = {s.op}({', '.join(s.inputs)}){' [open]' if s.id in open_ else ''}" for s in self.steps]

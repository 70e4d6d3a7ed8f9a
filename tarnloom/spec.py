"""The specification language: a graph of named steps over ten operators.

A specification is plain data. Each operator declares its fields once, with
type, default and checks; parsing, serialisation and the fingerprint follow
from the declaration. Unknown fields are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .errors import SpecError

REQUIRED = object()


@dataclass(frozen=True)
class Field:
    """``kind`` checks and converts a value; ``default`` REQUIRED means that there is none."""

    kind: Callable[[Any, str], Any]
    default: Any = REQUIRED


def text(value: Any, where: str) -> str:
    if not isinstance(value, str):
        raise SpecError(f"{where}: expected a string, got {value!r}")
    return value


def whole(value: Any, where: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise SpecError(f"{where}: expected an integer, got {value!r}")
    return value


def truth(value: Any, where: str) -> bool:
    if not isinstance(value, bool):
        raise SpecError(f"{where}: expected true or false, got {value!r}")
    return value


def one_of(*allowed: Any) -> Callable[[Any, str], Any]:
    def kind(value: Any, where: str) -> Any:
        if value not in allowed or isinstance(value, bool) != isinstance(allowed[0], bool):
            raise SpecError(f"{where}: {value!r} is not one of {', '.join(map(str, allowed))}")
        return value

    return kind


def many(item: Callable[[Any, str], Any], least: int = 0) -> Callable[[Any, str], list]:
    def kind(value: Any, where: str) -> list:
        if not isinstance(value, (list, tuple)) or len(value) < least:
            raise SpecError(f"{where}: expected a list of at least {least}")
        return [item(v, f"{where}[{i}]") for i, v in enumerate(value)]

    return kind


def mapping(item: Callable[[Any, str], Any]) -> Callable[[Any, str], dict]:
    def kind(value: Any, where: str) -> dict:
        if not isinstance(value, dict):
            raise SpecError(f"{where}: expected a mapping")
        return {text(k, where): item(v, f"{where}.{k}") for k, v in value.items()}

    return kind


def record(fields: dict[str, Field], check: Callable[[dict, str], None] | None = None) -> Callable[[Any, str], dict]:
    def kind(value: Any, where: str) -> dict:
        if not isinstance(value, dict):
            raise SpecError(f"{where}: expected a mapping")
        if extra := [k for k in value if k not in fields]:
            raise SpecError(f"{where}: unknown fields {', '.join(map(str, extra))}")
        out = {}
        for name, f in fields.items():
            given = value.get(name)
            if given is None:
                if f.default is REQUIRED:
                    raise SpecError(f"{where}: {name} is missing")
                out[name] = f.default() if callable(f.default) else f.default
            else:
                out[name] = f.kind(given, f"{where}.{name}")
        if check:
            check(out, where)
        return out

    return kind


def need(ok: Any, message: str) -> None:
    if not ok:
        raise SpecError(message)


def sha256_hex(value: Any, where: str) -> str:
    need(isinstance(value, str) and len(value) == 64 and not set(value) - set("0123456789abcdef"), f"{where}: not a SHA-256 in lower-case hex")
    return value


REF = record({"sha256": Field(sha256_hex), "source": Field(text, None)})
MISSING = one_of("error", "warn", "ignore")
LIST = {"file_names": Field(many(text), None), "file_names_ref": Field(REF, None)}


def _one_list(s: dict, where: str) -> None:
    need(bool(s["file_names"]) != (s["file_names_ref"] is not None), f"{where}: give exactly one of file_names and file_names_ref")


def _source(s: dict, where: str) -> None:
    need((s["image_batch"] is None) != (s["annotation_batch"] is None), f"{where}: give exactly one of image_batch and annotation_batch")


def _filter(s: dict, where: str) -> None:
    c = s["criterion"]
    need(s["mod"] is None or s["mod"] >= 2, f"{where}: mod must be at least 2")
    need(s["max_per_class"] is None or s["max_per_class"] >= 1, f"{where}: max_per_class must be at least 1")
    if c == "sample":
        need(s["mod"] is not None and s["keep_remainder"] is not None and s["seed"] is not None, f"{where}: sample needs mod, keep_remainder and seed")
        need(all(0 <= r < s["mod"] for r in s["keep_remainder"]), f"{where}: keep_remainder must lie in 0..mod-1")
        need(len(s["keep_remainder"]) < s["mod"], f"{where}: keep_remainder covers everything, so nothing is sampled")
    elif c == "predicate":
        need(s["expression"], f"{where}: predicate needs an expression")
    elif c == "explicit_list":
        _one_list(s, where)
    elif c == "balance":
        need(s["max_per_class"] is not None and s["seed"], f"{where}: balance needs max_per_class and a seed")


RULES = {"manual": "decisions", "annotator_precedence": "annotator_precedence", "batch_version_precedence": "version_precedence", "highest_score": None}


def _rule(r: dict, where: str) -> None:
    wanted = RULES[r["rule"]]
    need(wanted is None or r[wanted], f"{where}: {r['rule']} needs {wanted}")


def _override(o: dict, where: str) -> None:
    needed = "image_id" if o["action"].endswith("image") else "annotation_id"
    need(o[needed] is not None, f"{where}: {o['action']} needs {needed}")


DECISION = record({"keep_annotation_id": Field(whole), "reason": Field(text, "")})
RULE = record(
    {"rule": Field(one_of(*RULES)), "annotator_precedence": Field(many(text), None), "version_precedence": Field(many(text), None), "decisions": Field(many(DECISION), None)},
    _rule,
)
OVERRIDE = record(
    {
        "action": Field(one_of("exclude_image", "include_image", "exclude_annotation", "include_annotation")),
        "image_id": Field(whole, None),
        "annotation_id": Field(whole, None),
        "annotation_kind": Field(one_of("cls", "det"), "cls"),
        "reason": Field(text, ""),
    },
    _override,
)
INPUT = {"input": Field(text)}
#: op -> (fields, check). Field order is the order of written specifications.
OPS: dict[str, tuple[dict[str, Field], Callable[[dict, str], None] | None]] = {
    "source": ({"original_set": Field(text), "image_batch": Field(text, None), "annotation_batch": Field(text, None), "with_annotations": Field(truth, True)}, _source),
    "import_list": ({"original_set": Field(text), "image_batch": Field(text), **LIST, "on_missing": Field(MISSING, "error"), "with_annotations": Field(truth, True)}, _one_list),
    "union": ({"inputs": Field(many(text, 1))}, None),
    "intersect": ({"inputs": Field(many(text, 2))}, None),
    "except": ({"inputs": Field(many(text, 2))}, None),
    "filter": (
        {
            **INPUT,
            "criterion": Field(one_of("sample", "predicate", "explicit_list", "annotated", "balance")),
            "method": Field(one_of("hash_mod"), "hash_mod"),
            "key_field": Field(one_of("subject_id", "image_id", "file_name"), "subject_id"),
            "mod": Field(whole, None),
            "keep_remainder": Field(many(whole), None),
            "seed": Field(text, None),
            "expression": Field(text, None),
            "max_per_class": Field(whole, None),
            "by": Field(one_of("target", "local"), "target"),
            **LIST,
            "on_missing": Field(MISSING, "error"),
        },
        _filter,
    ),
    "dedup": ({**INPUT, "key": Field(one_of("blake3"), "blake3"), "source_priority": Field(many(text), list), "keep": Field(many(whole), list), "prefer_annotated": Field(truth, True)}, None),
    "category_map": (
        {**INPUT, "mapping": Field(mapping(mapping(text)), dict), "merge_identical": Field(truth, False), "require_total": Field(truth, True), "drop_unmapped": Field(truth, True)},
        None,
    ),
    "conflict_resolve": ({**INPUT, "rules": Field(many(RULE), list), "strict": Field(truth, True)}, None),
    "manual_override": ({**INPUT, "overrides": Field(many(OVERRIDE), list)}, None),
}


@dataclass(frozen=True)
class Step:
    id: str
    op: str
    params: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: Any, where: str = "step") -> Step:
        need(isinstance(data, dict), f"{where}: expected a mapping")
        op, name = data.get("op"), data.get("id")
        need(op in OPS, f"{where}: unknown op {op!r}")
        need(isinstance(name, str) and name, f"{where}: id is missing")
        fields, check = OPS[op]
        return cls(name, op, record(fields, check)({k: v for k, v in data.items() if k not in ("id", "op")}, f"step '{name}'"))

    @property
    def inputs(self) -> list[str]:
        return self.params.get("inputs") or ([self.params["input"]] if "input" in self.params else [])

    def __getitem__(self, name: str) -> Any:
        return self.params[name]

    def plain(self) -> dict[str, Any]:
        return {"id": self.id, "op": self.op, **_without_none(self.params)}


def _without_none(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _without_none(v) for k, v in value.items() if v is not None}
    return [_without_none(v) for v in value] if isinstance(value, list) else value


@dataclass(frozen=True)
class Spec:
    steps: tuple[Step, ...]
    final: str
    description: str | None = None
    version: int = 1

    @classmethod
    def parse(cls, data: Any) -> Spec:
        """A checked specification: unique ids, inputs declared before use, final declared."""
        shape = record({"version": Field(whole, 1), "description": Field(text, None), "steps": Field(lambda v, w: v), "final": Field(text)})(data, "spec")
        need(isinstance(shape["steps"], list) and shape["steps"], "spec: steps must be a list of at least one")
        steps: list[Step] = []
        seen: set[str] = set()
        for i, raw in enumerate(shape["steps"]):
            step = Step.parse(raw, f"steps[{i}]")
            need(step.id not in seen, f"step id '{step.id}' is used twice")
            for name in step.inputs:
                need(name in seen, f"step '{step.id}' uses '{name}', which no earlier step defines")
            seen.add(step.id)
            steps.append(step)
        need(shape["final"] in seen, f"final '{shape['final']}' is no step")
        return cls(tuple(steps), shape["final"], shape["description"], shape["version"])

    @classmethod
    def loads(cls, source: str) -> Spec:
        """From YAML, or from JSON where no YAML library is installed."""
        try:
            import yaml
        except ImportError:
            return cls.parse(json.loads(source))
        try:
            return cls.parse(yaml.safe_load(source))
        except yaml.YAMLError as error:
            raise SpecError(f"not YAML: {error}") from None

    def plain(self) -> dict[str, Any]:
        """Plain data with defaults filled in and absent values left out."""
        own = {"version": self.version, "description": self.description, "steps": [s.plain() for s in self.steps], "final": self.final}
        return {k: v for k, v in own.items() if v is not None}

    def dumps(self) -> str:
        try:
            import yaml
        except ImportError:
            return json.dumps(self.plain(), ensure_ascii=False, indent=2)
        return yaml.safe_dump(self.plain(), sort_keys=False, allow_unicode=True, default_flow_style=False)

    def fingerprint(self) -> str:
        """SHA-256 of the canonical JSON: sorted keys, no spaces, ASCII, description included."""
        return hashlib.sha256(json.dumps(self.plain(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

"""What operators work on and give back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from ..spec import Step

DECISION = "entity_kind string, entity_id long, decision string, reason string, detail string"
TARGETS = "category_id long, target string"


@dataclass(frozen=True)
class Candidates:
    """Images, their classification and detection annotations, and the target of each mapped category.

    Every annotation's image is among the images; ``prune`` restores that. Steps that only
    take images away leave ``base``, the annotations before any of them: what is left of
    them depends on the images that are left alone.
    """

    images: DataFrame
    cls: DataFrame
    det: DataFrame
    targets: DataFrame
    base: tuple[DataFrame, DataFrame] | None = None

    def with_(self, **changes: DataFrame) -> Candidates:
        """With other parts; other annotations have no base, and other images must be some of those before."""
        base = None if {"cls", "det"} & changes.keys() else self.base
        return Candidates(**{"images": self.images, "cls": self.cls, "det": self.det, "targets": self.targets} | changes, base=base)

    def prune(self) -> Candidates:
        ids = self.images.select("image_id")
        cls, det = self.base or (self.cls, self.det)
        kept = [f.join(ids, "image_id", "left_semi") for f in (cls, det)]
        return Candidates(self.images, *kept, self.targets, (cls, det))

    def keep_images(self, ids: DataFrame) -> Candidates:
        return self.with_(images=self.images.join(ids.select("image_id"), "image_id", "left_semi")).prune()

    def annotated(self) -> DataFrame:
        """(image_id) of images with any annotation."""
        return self.cls.select("image_id").union(self.det.select("image_id")).distinct()

    def mapped(self, kind: str = "cls") -> DataFrame:
        """Annotations with their target; unmapped ones have none."""
        return getattr(self, kind).join(self.targets, "category_id", "left")

    def used_categories(self) -> DataFrame:
        """(category_id, category, source) of the annotations."""
        columns = ("category_id", "category", "source")
        return self.cls.select(*columns).union(self.det.select(*columns)).distinct()

    def counts(self) -> dict[str, int]:
        return {"images": self.images.count(), "cls": self.cls.count(), "det": self.det.count()}


@dataclass
class Result:
    """An operator's outcome; statistics and decisions cost nothing until asked for."""

    candidates: Candidates
    warnings: list[str] = field(default_factory=list)
    _stats: Callable[[], dict[str, Any]] = dict
    _decisions: Callable[[], DataFrame | None] = lambda: None

    @cached_property
    def stats(self) -> dict[str, Any]:
        return self._stats()

    @property
    def decisions(self) -> DataFrame | None:
        """(entity_kind, entity_id, decision, reason, detail)."""
        return self._decisions()


Operator = Callable[[Catalog, list[Candidates], Step], Result]


def decided(kind: str, frame: DataFrame, key: str, decision: str, reason: Column | str, detail: Column | str = "") -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return frame.select(F.lit(kind).alias("entity_kind"), F.col(key).cast("long").alias("entity_id"), F.lit(decision).alias("decision"), as_column(reason).alias("reason"), as_column(detail).alias("detail"))


def dropped(before: Candidates, after: Candidates, reason: str, detail: Column | str = "") -> DataFrame:
    """Decisions for images that went, and for the annotations that went with them."""
    gone = before.images.join(after.images.select("image_id"), "image_id", "left_anti")
    out = decided("image", gone, "image_id", "dropped", reason, detail)
    for kind in ("cls", "det"):
        with_it = getattr(before, kind).join(gone.select("image_id"), "image_id", "left_semi")
        out = out.union(decided(kind, with_it, "ann_id", "dropped", f"{reason}:image_dropped"))
    return out


def subject_key() -> Column:
    """The subject, or the image itself where it is unknown (null or empty)."""
    return F.coalesce(F.when(F.col("subject_id") != "", F.col("subject_id")), F.concat(F.lit("__image__"), F.col("image_id").cast("string")))


def bucket(seed: str, key: Column, mod: int) -> Column:
    """First eight bytes of SHA-256(seed, NUL, key) as an unsigned number, modulo ``mod``."""
    head = F.substring(F.sha2(F.concat(F.lit(seed + "\0"), key), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(mod)).cast("long")

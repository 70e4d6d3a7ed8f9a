import hashlib

import pytest

from tarnloom.errors import SpecError
from tarnloom.operators.conflicts import find_conflicts
from tarnloom.operators.dedup import find_duplicates
from tarnloom.plans.runner import step_result
from tarnloom.plans.samples import step
from tests.conftest import rows
from tests.world import MAPPING, world


@pytest.fixture(scope="module")
def c(spark):
    return world(spark)


def do(c, own, op, **params):
    return step_result(c, step(op, **params), own if isinstance(own, list) else [own])


def ids(candidates):
    return tuple(sorted(r[0] for r in f.select(k).collect()) for f, k in ((candidates.images, "image_id"), (candidates.cls, "ann_id"), (candidates.det, "ann_id")))


@pytest.fixture(scope="module")
def left(c):
    return do(c, [], "source", original_set="left", image_batch="V1")


@pytest.fixture(scope="module")
def right(c):
    return do(c, [], "source", original_set="right", image_batch="V1")


@pytest.fixture(scope="module")
def both(c, left, right):
    return do(c, [left.candidates, right.candidates], "union").candidates


@pytest.fixture(scope="module")
def mapped(c, both):
    return do(c, both, "category_map", mapping=MAPPING).candidates


def test_sources(c, left, right):
    assert ids(left.candidates) == ([1, 2, 3, 4], [1, 2, 3, 4, 5], []) and left.stats["unannotated_images"] == 1
    assert ids(right.candidates) == ([5, 6, 7], [6, 7, 8], [1, 2])
    assert ids(do(c, [], "source", original_set="left", annotation_batch="V2").candidates) == ([1, 2], [4, 5], [])
    assert ids(do(c, [], "source", original_set="left", image_batch="V1", with_annotations=False).candidates) == ([1, 2, 3, 4], [], [])
    with pytest.raises(SpecError):
        do(c, [], "source", original_set="left", image_batch="V9")


def test_import_list(c):
    got = do(c, [], "import_list", original_set="left", image_batch="V1", file_names=["b.png", "a.png", "b.png", "zz"], on_missing="warn")
    assert ids(got.candidates)[0] == [1, 2] and got.stats["repeated_names"] == 1 and got.stats["matched_count"] == 2 and "zz" in got.warnings[0]
    with pytest.raises(SpecError):
        do(c, [], "import_list", original_set="left", image_batch="V1", file_names=["zz"])


def test_set_algebra(c, both, left, right):
    assert ids(do(c, [both, left.candidates], "intersect").candidates) == ids(left.candidates)
    gone = do(c, [both, left.candidates], "except")
    assert ids(gone.candidates) == ids(right.candidates) and sorted(r["entity_id"] for r in gone.decisions.collect()) == [1, 2, 3, 4]
    assert do(c, [both, right.candidates], "union").stats["image_overlap"] == 3
    one = both.with_(targets=c.spark.createDataFrame([(1, "x")], "category_id long, target string"))
    two = both.with_(targets=c.spark.createDataFrame([(1, "y")], "category_id long, target string"))
    with pytest.raises(SpecError):
        do(c, [one, two], "union")
    assert rows(do(c, [one, two], "except").candidates.targets) == [(1, "x")]


def test_filters(c, both, mapped):
    assert ids(do(c, both, "filter", criterion="annotated").candidates)[0] == [1, 2, 4, 5, 6, 7]
    got = do(c, both, "filter", criterion="explicit_list", file_names=["a.png", "zz"], on_missing="ignore")
    assert ids(got.candidates)[0] == [1, 5] and got.stats["matched_count"] == 2
    assert ids(do(c, mapped, "filter", criterion="predicate", expression="'tb' in targets or 'senior' in annotators").candidates)[0] == [1, 2, 6, 7]
    dropped = {(r["entity_kind"], r["entity_id"], r["reason"]) for r in do(c, both, "filter", criterion="predicate", expression="width > 99").decisions.collect()}
    assert ("image", 6, "filter:predicate") in dropped and ("det", 1, "filter:predicate:image_dropped") in dropped


def test_sample_is_deterministic_and_keeps_subjects(c, both):
    def place(key, mod):
        return int.from_bytes(hashlib.sha256(f"s\0{key}".encode()).digest()[:8], "big") % mod

    subject = {1: "S1", 2: "S1", 3: "__image__3", 4: "__image__4", 5: "S1", 6: "S2", 7: "__image__7"}
    for keep in ([0], [1, 2]):
        got = do(c, both, "filter", criterion="sample", mod=3, keep_remainder=keep, seed="s")
        assert ids(got.candidates)[0] == [i for i, k in subject.items() if place(k, 3) in keep]
    by_id = do(c, both, "filter", criterion="sample", mod=3, keep_remainder=[0], seed="s", key_field="image_id")
    assert ids(by_id.candidates)[0] == [i for i in subject if place(i, 3) == 0]


def test_balance_equals_the_greedy(c, mapped):
    got = do(c, mapped, "filter", criterion="balance", max_per_class=1, seed="even")
    member = {}
    for kind in ("cls", "det"):
        for r in mapped.mapped(kind).collect():
            member.setdefault(r["target"], set()).add(r["image_id"])
    place = lambda i: int.from_bytes(hashlib.sha256(f"even\0{i}".encode()).digest()[:8], "big") % 2**32
    kept = set()
    for name in sorted(member, key=lambda k: (len(member[k]), k)):
        kept |= set(sorted(member[name], key=lambda i: (i not in kept, place(i), i))[:1])
    assert ids(got.candidates)[0] == sorted(kept)
    with pytest.raises(SpecError):
        do(c, mapped.with_(targets=mapped.targets.limit(0)), "filter", criterion="balance", max_per_class=1, seed="even")


def test_dedup(c, both):
    assert ids(do(c, both, "dedup").candidates)[0] == [1, 2, 3, 4, 6, 7]
    assert ids(do(c, both, "dedup", source_priority=["right"]).candidates)[0] == [2, 3, 4, 5, 6, 7]
    pinned = do(c, both, "dedup", keep=[5, 99])
    assert ids(pinned.candidates)[0] == [2, 3, 4, 5, 6, 7] and pinned.stats["duplicate_groups"] == 1 and pinned.stats["cross_source_groups"] == 1 and pinned.stats["no_hash"] == 2
    with pytest.raises(SpecError):
        do(c, both, "dedup", keep=[1, 5])
    bare = both.with_(cls=both.cls.where("image_id <> 1"))
    assert 5 in ids(do(c, bare, "dedup").candidates)[0] and 1 in ids(do(c, bare, "dedup", prefer_annotated=False).candidates)[0]
    assert find_duplicates(both).first()["image_ids"] == [1, 5]


def test_category_map(c, both, mapped):
    assert dict(rows(mapped.targets)) == {1: "pneumonia", 2: "normal", 4: "normal", 5: "pneumonia", 6: "tb"}
    with pytest.raises(SpecError, match="right@V1:TB"):
        do(c, both, "category_map", mapping={"left@V1": MAPPING["left@V1"], "left@V2": MAPPING["left@V2"], "right@V1": {"PNEU": "p"}})
    loose = do(c, both, "category_map", mapping={"left@V1": {"Normal": "n", "Nope": "x"}, "gone@V1": {"A": "x"}}, require_total=False)
    assert ids(loose.candidates) == ([1, 2, 3, 4, 5, 6, 7], [2], []) and len(loose.warnings) == 3 and loose.stats["targets_without_source"] == ["x"]
    again = do(c, mapped, "category_map", mapping={"right@V1": {"TB": "tuberculosis"}}, merge_identical=True)
    assert dict(rows(again.candidates.targets))[6] == "tuberculosis" and again.decisions.where("entity_kind = 'category'").first()["detail"] == "tb -> tuberculosis"


def test_conflicts(c, mapped):
    assert rows(find_conflicts(mapped).select("image_id", "kind")) == [(1, "contradiction"), (2, "duplicate")]
    rule = lambda **r: do(c, mapped, "conflict_resolve", rules=[r], strict=False)
    assert ids(rule(rule="highest_score").candidates)[1] == [1, 2, 3, 6, 7, 8]
    assert ids(rule(rule="annotator_precedence", annotator_precedence=["senior"]).candidates)[1] == [3, 4, 5, 6, 7, 8]
    assert ids(rule(rule="batch_version_precedence", version_precedence=["V1"]).candidates)[1] == [1, 2, 3, 6, 7, 8]
    manual = rule(rule="manual", decisions=[{"keep_annotation_id": 4}])
    assert ids(manual.candidates)[1] == [2, 3, 4, 6, 7, 8] and len(manual.warnings) == 1
    with pytest.raises(SpecError):
        do(c, mapped, "conflict_resolve", rules=[], strict=True)
    tie = do(c, mapped, "conflict_resolve", rules=[{"rule": "highest_score"}, {"rule": "batch_version_precedence", "version_precedence": ["V2"]}])
    assert ids(tie.candidates)[1] == [1, 3, 5, 6, 7, 8] and tie.stats["resolved_by_rule"] == {"highest_score": 1, "batch_version_precedence": 1}


def test_overrides(c, left, both):
    own = left.candidates
    todo = lambda *o: do(c, own, "manual_override", overrides=list(o))
    got = todo({"action": "exclude_image", "image_id": 1, "reason": "blurred"}, {"action": "include_image", "image_id": 6})
    assert ids(got.candidates) == ([2, 3, 4, 6], [2, 3, 5, 7, 8], [1])
    assert {r["reason"] for r in got.decisions.collect()} == {"manual_override:blurred", "manual_override:include_image"}
    with pytest.raises(SpecError, match="image 99.*image 6 is not"):
        todo({"action": "exclude_image", "image_id": 99}, {"action": "exclude_image", "image_id": 6})
    with pytest.raises(SpecError, match="without any"):
        todo({"action": "exclude_annotation", "annotation_id": 1})
    assert ids(todo({"action": "exclude_image", "image_id": 3}, {"action": "exclude_annotation", "annotation_id": 1}).candidates)[1] == [2, 3, 4, 5]
    assert ids(todo({"action": "exclude_image", "image_id": 1}, {"action": "include_image", "image_id": 1}).candidates) == ids(own)

import json

import pytest

from tarnloom.errors import SpecError
from tarnloom.functions.predicate import compile_predicate
from tarnloom.spec import Spec

SOURCE = {"id": "a", "op": "source", "original_set": "left", "image_batch": "V1"}


def spec(*steps, final=None, **more):
    return Spec.parse({"steps": [SOURCE, *steps], "final": final or ([SOURCE, *steps][-1]["id"]), **more})


@pytest.mark.parametrize(
    "step",
    [
        {"id": "b", "op": "nothing"},
        {"id": "a", "op": "union", "inputs": ["a"]},
        {"id": "b", "op": "union", "inputs": ["later"]},
        {"id": "b", "op": "union", "inputs": []},
        {"id": "b", "op": "intersect", "inputs": ["a"]},
        {"id": "b", "op": "source", "original_set": "x"},
        {"id": "b", "op": "source", "original_set": "x", "image_batch": "V1", "annotation_batch": "V1"},
        {"id": "b", "op": "import_list", "original_set": "x", "image_batch": "V1"},
        {"id": "b", "op": "import_list", "original_set": "x", "image_batch": "V1", "file_names": []},
        {"id": "b", "op": "import_list", "original_set": "x", "image_batch": "V1", "file_names_ref": {"sha256": "zz"}},
        {"id": "b", "op": "filter", "input": "a", "criterion": "sample"},
        {"id": "b", "op": "filter", "input": "a", "criterion": "sample", "mod": 1, "keep_remainder": [0], "seed": "s"},
        {"id": "b", "op": "filter", "input": "a", "criterion": "sample", "mod": 2, "keep_remainder": [2], "seed": "s"},
        {"id": "b", "op": "filter", "input": "a", "criterion": "sample", "mod": 2, "keep_remainder": [0, 1], "seed": "s"},
        {"id": "b", "op": "filter", "input": "a", "criterion": "predicate"},
        {"id": "b", "op": "filter", "input": "a", "criterion": "balance", "max_per_class": 5, "seed": ""},
        {"id": "b", "op": "filter", "input": "a", "criterion": "balance", "max_per_class": 0, "seed": "s"},
        {"id": "b", "op": "dedup", "input": "a", "key": "md5"},
        {"id": "b", "op": "dedup", "input": "a", "extra": 1},
        {"id": "b", "op": "conflict_resolve", "input": "a", "rules": [{"rule": "manual"}]},
        {"id": "b", "op": "manual_override", "input": "a", "overrides": [{"action": "exclude_image"}]},
    ],
)
def test_refused(step):
    with pytest.raises(SpecError):
        spec(step)


def test_final_and_emptiness():
    with pytest.raises(SpecError):
        spec(final="zz")
    with pytest.raises(SpecError):
        Spec.parse({"steps": [], "final": "a"})
    with pytest.raises(SpecError):
        Spec.loads("[not: a, spec")


def test_round_trip_and_fingerprint():
    own = spec({"id": "b", "op": "dedup", "input": "a"}, description="größe")
    assert Spec.loads(own.dumps()) == own and Spec.loads(json.dumps(own.plain())) == own
    assert own.fingerprint() == Spec.loads(own.dumps()).fingerprint()
    assert own.fingerprint() != spec({"id": "b", "op": "dedup", "input": "a"}).fingerprint()
    assert own.plain()["steps"][1] == {"id": "b", "op": "dedup", "input": "a", "key": "blake3", "source_priority": [], "keep": [], "prefer_annotated": True}
    explicit = spec({"id": "b", "op": "dedup", "input": "a", "prefer_annotated": True}, description="größe")
    assert explicit.fingerprint() == own.fingerprint()


ROWS = "file_name string, original_set string, width int, height int, date_captured date, subject_id string, labels array<string>, n_annotations int"


@pytest.fixture(scope="module")
def table(spark):
    from datetime import date

    data = [("a.png", "x", 10, 20, date(2022, 6, 1), "S1", ["Normal", "TB"], 2), ("b٣.jpg", "y", None, 5, None, None, [], 0), ("", "", 0, 0, date(2020, 1, 1), "", None, None)]
    return spark.createDataFrame(data, ROWS).cache()


@pytest.mark.parametrize(
    "expression,want",
    [
        ("width > 5", "a.png"),
        ("not width > 5", "b٣.jpg|"),
        ("width != 10", "b٣.jpg|"),
        ("width == None", ""),
        ("width != None", "a.png|"),
        ("width is None", "b٣.jpg"),
        ("subject_id is not None and subject_id", "a.png"),
        ("5 <= width <= 10 and height == 20", "a.png"),
        ("area > 100", "a.png"),
        ("date_captured >= '2022-01-01'", "a.png"),
        ("date_captured in ['2022-06-01']", ""),
        ("width == '10'", ""),
        ("width in [10, 'x', None]", "a.png|b٣.jpg"),
        ("original_set not in ['x']", "b٣.jpg|"),
        ("'TB' in labels", "a.png"),
        ("'png' in file_name", "a.png"),
        ("regex(file_name, 'b\\\\d[.]jpg$')", "b٣.jpg"),
        ("regex(width, '^1')", "a.png"),
        ("labels or file_name == ''", "a.png|"),
        ("n_annotations", "a.png"),
        ("1 < 2", "a.png|b٣.jpg|"),
    ],
)
def test_predicates_have_two_values(table, expression, want):
    got = {r[0] for r in table.where(compile_predicate(expression).condition).select("file_name").collect()}
    assert got == (set(want.split("|")) if want else set()) or (want == "" and got == set())


@pytest.mark.parametrize("bad", ["__import__('os')", "file_name.upper()", "[x for x in labels]", "lambda: 1", "width + 1 > 2", "width > -1", "nope == 1", "width >", "width < 'a'", "regex(file_name, '(?P<a>x)')", "regex(file_name, '(')", "1 in width", "width is 3", "date_captured > 'soon'"])
def test_predicates_refuse(bad):
    with pytest.raises(SpecError):
        compile_predicate(bad)

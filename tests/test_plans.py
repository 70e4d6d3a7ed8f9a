import io
import json

import pytest

from tarnloom import cli, meta
from tarnloom.errors import SpecError
from tarnloom.plans import checks, reads
from tarnloom.plans.publish import Author, Store, build, parse_ref
from tarnloom.plans.runner import explain, run
from tarnloom.plans.session import Session
from tarnloom.sources import ingest, lists, sinks
from tarnloom.sources.catalog import SCHEMAS, Catalog
from tarnloom.spec import Spec
from tests.conftest import rows
from tests.world import MAPPING, TABLES, world

STEPS = [
    {"id": "l", "op": "source", "original_set": "left", "image_batch": "V1"},
    {"id": "r", "op": "source", "original_set": "right", "image_batch": "V1"},
    {"id": "u", "op": "union", "inputs": ["l", "r"]},
    {"id": "n", "op": "filter", "input": "u", "criterion": "annotated"},
    {"id": "d", "op": "dedup", "input": "n"},
    {"id": "m", "op": "category_map", "input": "d", "mapping": MAPPING},
    {"id": "c", "op": "conflict_resolve", "input": "m", "rules": [{"rule": "annotator_precedence", "annotator_precedence": ["senior", "junior"]}]},
]
SPEC = Spec.parse({"steps": STEPS, "final": "c"})


@pytest.fixture(scope="module")
def c(spark):
    return world(spark)


@pytest.fixture(scope="module")
def store(spark, c, tmp_path_factory):
    own = Store(spark, str(tmp_path_factory.mktemp("sets")))
    build(c, own, SPEC, "lungs", "V1", Author("a", "a@b"))
    return own


def test_build_publishes_once(c, store):
    m = store.manifest("lungs", "V1")
    assert m["counts"] == {"images": 5, "cls": 5, "det": 2, "targets": 3, "mappings": 4}
    assert rows(store.table("lungs", "V1", "images")) == [(1,), (2,), (4,), (6,), (7,)]
    assert rows(store.table("lungs", "V1", "cls")) == [(3, 4), (4, 1), (5, 2), (7, 6), (8, 6)]
    assert store.spec("lungs", "V1") == (SPEC, "ok")
    with pytest.raises(SpecError, match="exists"):
        build(c, store, SPEC, "lungs", "V1", Author("a", "a@b"))
    with pytest.raises(SpecError):
        build(c, store, Spec.parse({"steps": STEPS[:3], "final": "u"}), "lungs", "V2", Author("a", "a@b"))
    assert [m["version"] for m in store.versions()] == ["V1"] and not store.fs.exists(store._path("lungs", "V2"))
    done, nothing = build(c, store, SPEC, "lungs", "V3", Author("a", "a@b"), dry_run=True)
    assert nothing is None and done.final.counts()["images"] == 5


def test_unreachable_steps_still_fail(c):
    with pytest.raises(SpecError):
        run(c, Spec.parse({"steps": [*STEPS, {"id": "x", "op": "source", "original_set": "left", "image_batch": "V7"}], "final": "c"}))


def test_modified_and_missing_specs(c, spark, tmp_path):
    own = Store(spark, str(tmp_path))
    build(c, own, SPEC, "s", "V1", Author("a", "a@b"))
    own.write_text(Spec.parse({"steps": STEPS, "final": "c", "description": "x"}).dumps(), "s", "V1", "spec.yaml")
    assert own.spec("s", "V1")[1] == "modified"
    own.fs.delete(own._path("s", "V1", "spec.yaml"), False)
    assert own.spec("s", "V1") == (None, "missing")
    assert own.describe_deletion("s", "V1")[0]["removes_set"] and own.delete("s") == ["s@V1"] and own.versions() == []
    with pytest.raises(SpecError):
        own.delete("s")
    assert parse_ref("a@b@V1") == ("a@b", "V1")


def test_reads_of_a_version(c, store):
    own = reads.stored(c, store, "lungs", "V1")
    assert rows(reads.composition(own)) == [("left", "V1", 3), ("right", "V1", 2)]
    assert rows(reads.subjects_summary(own)) == [(2, 2, 2)]
    got = {r["target"]: tuple(r)[1:] for r in reads.category_distribution(own).collect()}
    assert got == {"normal": (2, 0, 3, 0, 0, 0), "pneumonia": (1, 1, 3, 0, 0, 0), "tb": (1, 0, 4, 1, 1, 2)}
    assert rows(checks.version_checks(own, own).where("violations > 0").select("seq")) == [(1,), (2,)]
    assert {r[2] for r in checks.manifest_checks(store.versions())} == {0}
    assert {r["seq"]: r["violations"] for r in checks.source_checks(c).collect() if r["violations"]} == {9: 1}
    detail = reads.image_detail(c, 1, store)
    assert detail["duplicates"][0]["image_id"] == 5 and detail["lineage"][0]["relative_id"] == 6 and detail["used_by"][0]["version"] == "lungs@V1"
    assert reads.resolve_image(c, "a.png", lowest=True) == 1 and reads.resolve_image(c, "right/V1/a.png") == 5
    with pytest.raises(SpecError):
        reads.resolve_image(c, "a.png")


def test_explain(c):
    done = run(c, SPEC)
    trail = [(r["step"], r["entity_kind"], r["entity_id"], r["decision"], r["reason"]) for r in explain(done, 5).collect()]
    assert trail == [("r", "cls", 6, "added", "source"), ("r", "image", 5, "added", "source"), ("d", "cls", 6, "dropped", "dedup:blake3:image_dropped"), ("d", "image", 5, "dropped", "dedup:blake3")]
    assert ("c", 1, "conflict_resolve:annotator_precedence") in [(r["step"], r["entity_id"], r["reason"]) for r in explain(done, 1).collect()]


def test_exports(c, store, spark, tmp_path):
    own = reads.stored(c, store, "lungs", "V1")
    document = json.loads("".join(sinks.coco_document(own)))
    assert [x["name"] for x in document["categories"]] == ["normal", "pneumonia", "tb"] and len(document["annotations"]) == 2
    assert document["annotations"][0]["area"] == 12.0 and document["annotations"][1]["segmentation"] == [[1.0, 2.0, 3.0, 4.0]]
    sinks.write_layout(own, str(tmp_path / "p"))
    labels = spark.read.parquet(str(tmp_path / "p/cls_annotations"))
    assert sorted(r["id"] for r in labels.collect()) == [1, 2, 3, 4, 5] and set(labels.columns) == {"id", "image_id", "category_id", "score", "annotator_id", "source_version"}
    sinks.write_csv(own, str(tmp_path / "csv"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert any(x.startswith("4,left/images/V1/d,left,V1,d,300,300,") for x in lines) and len(lines) >= 6
    assert sinks.bundle(own, "x: 1")[:2] == b"PK"
    run_length = own.with_(det=own.det.selectExpr("*").withColumn("segmentation", __import__("pyspark").sql.functions.lit('{"counts": 1}')))
    with pytest.raises(SpecError):
        sinks.check_polygons(run_length.det)


def test_session(c, spark, tmp_path):
    s = Session(world(spark), str(tmp_path / "lists"))
    s.add_source("left", image_batch="V1")
    with pytest.raises(SpecError):
        s.union()
    s.add_source("right", image_batch="V1")
    s.union()
    s.keep_annotated_only()
    s.checkpoint("here")
    s.split(2, [0], "x")
    s.rollback("here")
    assert len(s.steps) == 4 and s.head == "filter_1"
    with pytest.raises(SpecError):
        s.filter("nope > 1")
    assert len(s.steps) == 4
    s.dedup()
    s.undo()
    s.dedup()
    s.map_category(MAPPING)
    s.resolve_by_annotator(["senior", "junior"])
    spec = s.compile("a set")
    assert spec.steps[-1]["strict"] and spec.steps[-2]["require_total"] and run(c, spec).final.counts()["images"] == 5
    fresh = Session(c)
    fresh.replay(spec)
    assert fresh.current.counts() == s.current.counts() and len(fresh.describe()) == 7
    names = Session(world(spark), str(tmp_path / "lists"))
    names.import_list("left", "V1", ["a.png"] + [f"{i}.png" for i in range(300)], "delivery", on_missing="warn")
    assert names.steps[0]["file_names_ref"]["source"] == "delivery" and names.last_import_report()["missing_count"] == 300


def test_lists(spark, tmp_path):
    path = str(tmp_path / "lists")
    key = lists.register(spark, path, [" a ", "", "b", "a"])
    assert key == lists.digest(["a", "b", "a"]) == lists.register(spark, path, ["a", "b", "a"]) and lists.browse(spark, path).count() == 1
    c = Catalog(spark, {"import_lists": spark.read.parquet(path)})
    assert lists.fetch(c, key[:8]) == ["a", "b", "a"] and rows(c.table("import_lists").select(lists.digest_column("file_names"))) == [(key,)]
    with pytest.raises(SpecError):
        lists.fetch(c, "zz")


def test_a_prefix_is_looked_up_among_all_lists(spark):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    many = [(lists.digest([f"n{i}"]), [f"n{i}"], None, day + datetime.timedelta(minutes=i)) for i in range(700)]
    c = Catalog(spark, {"import_lists": spark.createDataFrame([*many, many[0]], SCHEMAS["import_lists"])})
    assert lists.fetch(c, many[0][0][:20]) == ["n0"]
    with pytest.raises(SpecError, match="ambiguous"):
        lists.fetch(c, next(p for p in "0123456789abcdef" if sum(m[0].startswith(p) for m in many) > 1))


def test_cli_and_shell(c, spark, store, tmp_path, capsys):
    for name, data in TABLES.items():
        spark.createDataFrame(data, SCHEMAS[name]).write.parquet(str(tmp_path / "originals" / name))
    (tmp_path / "spec.yaml").write_text(SPEC.dumps())
    context = cli.Context(str(tmp_path))
    call = lambda *a: cli.main(list(a), context)
    assert call("validate", str(tmp_path / "spec.yaml")) == 0 and call("build", str(tmp_path / "spec.yaml"), "-m", "lungs", "-v", "V1") == 0
    assert call("build", str(tmp_path / "spec.yaml"), "-m", "lungs", "-v", "V1") == 1 and "exists" in capsys.readouterr().err
    for args in (["ls", "sets"], ["ls", "manual-sets"], ["show", "lungs@V1"], ["spec", "lungs@V1"], ["image", "1"], ["diff", "lungs@V1", "lungs@V1"], ["check"], ["export", "lungs@V1", "coco", str(tmp_path / "x.json")], ["why", "lungs@V1", "5"], ["rm", "lungs@V1", "--yes"]):
        assert call(*args) == 0, args
    assert call("check-leakage", "lungs@V1", "lungs@V1") == 1
    out = io.StringIO()
    shell = cli.Shell(Session(world(spark)), store, stdout=out)
    for line in ("source left@V1", "source left@V1 image", "source right@V1 image", "union", "annotated", "dedup", "duplicates", "merge_identical", "conflicts", "resolve score", "steps", "preview", "spec", "undo", "nonsense"):
        assert not shell.onecmd(line)
    assert "say which" in out.getvalue() and "auto" not in out.getvalue() and shell.onecmd("quit")


def test_ingest(c, spark):
    images = spark.createDataFrame([(10, "a.png", "V1"), (11, "b.png", "V1"), (12, "zz.png", "V1")], "id long, file_name string, source_version string")
    files = {
        "images": images,
        "categories": spark.createDataFrame([(1, "New"), (2, "Unused"), (3, "OnlyBad")], "id long, name string"),
        "annotators": spark.createDataFrame([(5, "junior"), (6, "fresh")], "id long, name string"),
        "cls_annotations": spark.createDataFrame([(10, 1, None, 5), (11, 1, 0.5, 6), (12, 2, 0.5, 6)], "image_id long, category_id long, score double, annotator_id long"),
        "det_annotations": spark.createDataFrame([(10, 3, [1.0], 5)], "image_id long, category_id long, bbox array<double>, annotator_id long"),
    }
    with pytest.raises(SpecError):
        ingest.annotation_batch(c, "left", 9, files)
    got = ingest.annotation_batch(c, "left", 9, files, on_missing="skip")
    assert rows(got.rows["categories"].select("id", "name")) == [(7, "New")] and rows(got.rows["annotators"]) == [(4, "fresh")]
    assert set(rows(got.rows["cls_annotations"].select("id", "image_id", "category_id", "score", "annotator_id"))) == {(9, 1, 7, 0.0, 1), (10, 2, 7, 0.5, 4)}
    assert got.refused.count() == 2
    more = ingest.image_batch(c, 1, spark.createDataFrame([("a.png", 1, 1, None), ("n.png", 2, 2, "0000-00-00")], "file_name string, width int, height int, date_captured string"), "skip")
    assert rows(more.rows["images"].select("id", "file_name", "date_captured")) == [(8, "n.png", None)]
    assert rows(ingest.build_lineage(c, 1, 2)) == [(1, 5)] and rows(ingest.build_lineage(c, 1, 2, ("^e", "b"))) == [(1, 5), (2, 6)]
    filled = ingest.backfill_hashes(c.table("images"), spark.createDataFrame([(3, "C" * 64), (1, "d" * 64)], "image_id long, blake3_hash string"))
    assert {r["id"]: r["blake3_hash"] for r in filled.collect()}[3] == "c" * 64 and {r["id"]: r["blake3_hash"] for r in filled.collect()}[1] == "a" * 64


def test_nothing_is_dropped_without_a_reason(c, spark):
    f = spark.createDataFrame
    files = {
        "images": f([(10, "a.png", "V1", 7, "2020-02-30"), (11, "c.jpg", "V1", 7, "2019-05-06")], "id long, file_name string, source_version string, license long, date_captured string"),
        "licenses": f([(7, "CC-BY", None)], "id long, name string, url string"),
        "categories": f([(1, "Pneumonia", "x"), (2, "Twice", None), (3, "Twice", "b")], "id long, name string, supercategory string"),
        "annotators": f([(5, "junior")], "id long, name string"),
        "cls_annotations": f([(10, 1, 0.5, 5), (10, 1, 0.5, 5), (10, 1, 0.6, 5), (11, 9, 0.5, 5), (11, 1, 0.5, 99), (11, 2, 0.5, 5), (11, 3, 0.7, 5)], "image_id long, category_id long, score double, annotator_id long"),
    }
    with pytest.raises(SpecError, match="twice"):
        ingest.annotation_batch(c, "left", 1, files)
    got = ingest.annotation_batch(c, "left", 1, files, on_duplicate="skip")
    assert sorted(r["reason"] for r in got.refused.collect()) == ["annotator not in the delivery", "category not in the delivery", "claim made twice"]
    # the batch has a Pneumonia already; the new category follows the ids of all batches, and its values are of one row
    assert rows(got.rows["categories"].select("id", "name", "supercategory")) == [(7, "Twice", None)]
    assert rows(got.rows["cls_annotations"].select("image_id", "category_id", "score", "annotator_id")) == [(1, 1, 0.5, 1), (1, 1, 0.6, 1), (3, 7, 0.5, 1), (3, 7, 0.7, 1)]
    # gaps of stored images are filled, what they have stays, and a date that is none is no date
    assert rows(got.rows["licenses"].select("id", "name")) == [(1, "CC-BY")]
    assert [tuple(map(str, r)) for r in got.updates["images"].collect()] == [("3", "1", "2019-05-06")]
    # the same again adds nothing
    own = world(spark)
    own.tables["cls_annotations"] = own.tables["cls_annotations"].unionByName(got.rows["cls_annotations"].select(own.tables["cls_annotations"].columns))
    own.tables["categories"] = own.tables["categories"].union(got.rows["categories"].select(own.tables["categories"].columns))
    again = ingest.annotation_batch(own, "left", 1, files, on_duplicate="skip")
    assert again.rows["cls_annotations"].count() == 0 and again.rows["categories"].count() == 0 and again.refused.where("reason = 'stored already'").count() == 4


def test_image_deliveries(c, spark):
    given = spark.createDataFrame([("a.png", 5, 6, "9" * 64), ("n.png", 2, 9, None), ("n.png", 3, 1, None)], "file_name string, width int, height int, blake3_hash string")
    skip, over = (ingest.image_batch(c, 1, given, how) for how in ("skip", "overwrite"))
    assert rows(skip.rows["images"].select("file_name", "width", "height")) == [("n.png", 2, 9)]  # a row that was delivered, not the least of each column
    assert sorted(r["reason"] for r in skip.refused.collect()) == ["delivered more than once: n.png", "registered already: a.png"] and not skip.updates
    assert over.refused.count() == 1
    new = {r["id"]: r for r in ingest.replaced(c.table("images"), over.updates["images"]).collect()}
    assert (new[1]["width"], new[1]["blake3_hash"][0], new[1]["license_id"], new[2]["width"]) == (5, "9", 1, 200)


def test_import_and_notes_from_the_command_line(spark, tmp_path, capsys):
    for name, frame in world(spark).tables.items():
        frame.write.parquet(str(tmp_path / "originals" / name))
    spark.createDataFrame([(1, "a.png", "V1"), (2, "c.jpg", "V1")], "id long, file_name string, source_version string").coalesce(1).write.parquet(str(tmp_path / "in/images.parquet"))
    spark.createDataFrame([(1, 4, 0.5, 1), (2, 4, 0.25, 1)], "image_id long, category_id long, score double, annotator_id long").write.parquet(str(tmp_path / "in/cls_annotations.parquet"))
    spark.createDataFrame([(4, "Nodule")], "id long, name string").write.parquet(str(tmp_path / "in/categories.parquet"))
    spark.createDataFrame([(1, "newcomer")], "id long, name string").write.parquet(str(tmp_path / "in/annotators.parquet"))
    spark.createDataFrame([("a.png", 11, 12), ("z.png", 13, 14)], "file_name string, width int, height int").write.parquet(str(tmp_path / "pics/images.parquet"))

    def call(*arguments):
        context = object.__new__(cli.Context)
        context.root, context.spark, context.lists = str(tmp_path), spark, ""
        context.catalog, context.store = Catalog.open(spark, f"{tmp_path}/originals"), Store(spark, str(tmp_path / "manual_sets"))
        assert cli.main(list(arguments), context) == 0, capsys.readouterr().err
        return capsys.readouterr().out

    assert '"cls_annotations": 2' in call("import", "annotations", "left@V2", str(tmp_path / "in"))
    assert "stored already" in call("import", "annotations", "left@V2", str(tmp_path / "in"))
    out = call("import", "images", "left@V1", str(tmp_path / "pics"), "--on-conflict", "overwrite")
    assert '"images updated": 1' in out and '"images": 1' in out
    assert "images\t8\n" in call("db", "status") and "11" in call("meta", "images", "left@V1") and "Nodule" in call("meta", "annotations", "left@V2")


def test_two_builders_of_one_version(c, spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    own = Store(spark, str(tmp_path))

    def attempt(who: str, version: str = "V1") -> str:
        try:
            build(c, own, SPEC, "s", version, Author(who, f"{who}@b"))
            return who
        except SpecError as error:
            return str(error)

    with ThreadPoolExecutor(2) as pool:
        said = list(pool.map(attempt, ("ann", "ben")))
    won = [s for s in said if s in ("ann", "ben")]
    assert len(won) == 1 and own.manifest("s", "V1")["created_by"] == won[0] and won[0] in next(s for s in said if s != won[0])
    assert sorted(f.getPath().getName() for f in own.fs.listStatus(own._path("s", "V1"))) == sorted(["images", "cls", "det", "targets", "mappings", "spec.yaml", "__meta__.md", "manifest.json"])
    # a claim of a builder that was lost is in the way until it is removed
    assert own.claim("s", "V2", "lost") and "lost" in attempt("cid", "V2")
    assert own.delete("s", "V2") == ["the claim of s@V2"] and build(c, own, SPEC, "s", "V2", Author("cid", "c@b"))[1]["created_by"] == "cid"


def test_fingerprint_of_a_known_specification():
    """The canonical form hashes to the published value."""
    # fixed values: what was hashed
    text = 'Pneumonia 訓練集：三個來源合併去重後，依 subject_id 決定性切出 3/4。 同一個 seed 永遠切出同一批病患，val 用同一組 seed 取補集， 兩邊保證不會有同一位病患的影像（§8 原則 5）。\n'
    rules = [{"rule": "annotator_precedence", "annotator_precedence": ["radiologist_senior", "dr_lee", "radiologist_junior"]}, {"rule": "highest_score"}]
    names = {"aws_images@V2": {"Pneumonia": "pneumonia", "Normal": "normal", "Effusion": "effusion"}, "TB-portal@V1": {"TB": "tb", "Normal": "normal", "Pneumonia": "pneumonia"}, "DrLee@V1": {"pneumonia": "pneumonia", "normal": "normal"}}
    steps = [
        {"id": "aws", "op": "source", "original_set": "aws_images", "annotation_batch": "V2"},
        {"id": "tb", "op": "source", "original_set": "TB-portal", "annotation_batch": "V1"},
        {"id": "drlee", "op": "source", "original_set": "DrLee", "annotation_batch": "V1"},
        {"id": "pooled", "op": "union", "inputs": ["aws", "tb", "drlee"]},
        {"id": "pooled_deduped", "op": "dedup", "input": "pooled", "key": "blake3", "source_priority": ["TB-portal", "DrLee", "aws_images"]},
        {"id": "train_split", "op": "filter", "input": "pooled_deduped", "criterion": "sample", "method": "hash_mod", "key_field": "subject_id", "mod": 4, "keep_remainder": [0, 1, 2], "seed": "pneumonia-2026-split"},
        {"id": "mapped", "op": "category_map", "input": "train_split", "mapping": names},
        {"id": "resolved", "op": "conflict_resolve", "input": "mapped", "rules": rules, "strict": True},
    ]
    assert Spec.parse({"description": text, "steps": steps, "final": "resolved"}).fingerprint().startswith("186ef577cb45cbe0")


def test_lazy_steps_give_what_written_ones_do(c, monkeypatch):
    from tarnloom.plans import runner

    want = {k: rows(getattr(runner.run(c, SPEC).final, k)) for k in ("images", "cls", "det", "targets")}
    assert runner.written(SPEC) == {"u", "n", "d", "m"} and set(runner.fused(c, SPEC)) == {"u"}
    monkeypatch.setattr(runner, "written", lambda spec: {s.id for s in spec.steps})
    monkeypatch.setattr(runner, "fused", lambda catalog, spec: {})
    assert {k: rows(getattr(runner.run(c, SPEC).final, k)) for k in want} == want


def test_batch_filter_reaches_the_scan(spark):
    from tarnloom.operators.sources import image_batches
    from tarnloom.plans import samples

    own = image_batches(samples.catalog(spark, "/root/testdata/sf0.001"), [1, 2], True)
    plan = own.cls._jdf.queryExecution().toString()
    assert "In(image_batch_id, [1,2])" in plan
    # the semi join comes before the rows are shuffled by their id
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.index("ann_id") < physical.rindex("LeftSemi")


def test_image_files_and_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (8).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"\x10\x00\x00\x00\x00"
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.txt").write_text("x")
    assert [tuple(r)[:4] for r in ingest.image_files(spark, str(tmp_path)).collect()] == [("a.png", 8, 9, 16)] and meta.bit_depth(png) == "uint16"
    assert ingest.header(b"") == (None, None, None)


def test_jpeg_sizes_behind_long_segments(spark, tmp_path):
    segment = b"\xff\xe1\xff\xff" + bytes(65533)
    size = b"\xff\xc0\x00\x11\x08" + (700).to_bytes(2, "big") + (900).to_bytes(2, "big") + bytes(10)
    for n in (0, 1, 5):
        (tmp_path / f"{n}.jpg").write_bytes(b"\xff\xd8" + segment * n + size)
    assert sorted(tuple(r)[:4] for r in ingest.image_files(spark, str(tmp_path)).collect()) == [(f"{n}.jpg", 900, 700, 8) for n in (0, 1, 5)]


def test_notes():
    text = meta.version_note({"name": "n|x", "version": "V1", "created_by": "a\nb", "created_at": "t", "counts": {"images": 3}}, [("s", "V1", 3)], [], [], "two\nlines")
    assert "n\\|x" in text and "> two\n> lines" in text and "(none)" not in text.split("## Sources")[0]


def test_intake_takes_every_row_once(spark, tmp_path):
    from tarnloom.streaming.intake import follow

    rows_ = [(1, 1, 1, 1, float("nan"), 1), (2, 1, 1, 1, 0.5, 1), (1, 1, 1, 1, 0.5, 1)]
    made = spark.createDataFrame(rows_, SCHEMAS["cls_annotations"]).selectExpr("*", "timestamp'2024-01-01 00:00:00' AS delivered_at")
    made.write.parquet(str(tmp_path / "in/1"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id")) == [(1,), (2,)]


def test_intake_keeps_boxes_without_a_score(spark, tmp_path):
    from tarnloom.streaming.intake import follow

    made = spark.createDataFrame([(1, 1, 1, 1, [1.0, 1.0, 2.0, 2.0], None, 0, None, 1)], SCHEMAS["det_annotations"]).selectExpr("*", "timestamp'2024-01-01 00:00:00' AS delivered_at")
    made.write.parquet(str(tmp_path / "in/1"))
    follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), table="det_annotations", once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["score"] is None


def test_intake_takes_late_rows_and_no_late_repeats(spark, tmp_path):
    from tarnloom.streaming.intake import follow

    for k, (day, ids) in enumerate([("2024-03-01", [1, 2]), ("2024-03-02", [2, 3]), ("2024-01-01", [4, 1]), ("2024-06-01", [1, 5]), ("2024-06-02", [3, 6])]):
        made = spark.createDataFrame([(i, 1, 1, 1, 0.5, 1) for i in ids], SCHEMAS["cls_annotations"]).selectExpr("*", f"timestamp'{day} 00:00:00' AS delivered_at")
        made.write.parquet(str(tmp_path / f"in/{k}"))
        follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("id")) == [(i,) for i in range(1, 7)]
    assert [c for c in got.columns if c != "intake"] == [c.split()[0] for c in SCHEMAS["cls_annotations"].split(", ")] + ["delivered_at"]

"""Command line and interactive shell.

Errors are one line and exit status 1; set TARNLOOM_DEBUG for tracebacks.
"""

from __future__ import annotations

import argparse
import cmd
import json
import os
import shlex
import sys
from collections.abc import Callable

from pyspark.sql import functions as F

from . import meta as notes
from .errors import SpecError
from .functions.spread import release, union_all
from .plans import checks, reads
from .plans.publish import Author, Store, build, parse_ref
from .plans.runner import explain, run
from .plans.session import Session
from .sources import ingest, lists, sinks
from .sources.catalog import SCHEMAS, Catalog
from .spec import Spec


def spark():
    from .session import get_spark

    return get_spark("tarnloom")


class Context:
    """Warehouse layout: ``originals`` tables, ``manual_sets`` versions, ``originals/import_lists`` lists."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.spark = spark()
        self.catalog = Catalog.open(self.spark, f"{self.root}/originals")
        self.store = Store(self.spark, f"{self.root}/manual_sets")
        self.lists = f"{self.root}/originals/import_lists"

    def spec(self, source: str) -> tuple[Spec, str]:
        """A specification from a file, or of a published version."""
        if os.path.exists(source):
            with open(source, encoding="utf-8") as f:
                return Spec.loads(f.read()), "file"
        spec, state = self.store.spec(*parse_ref(source))
        if spec is None:
            raise SpecError(f"the specification of {source} is {state}")
        return spec, state


def show(frame, most: int = 200) -> None:
    rows = frame.limit(most).collect()
    print("\t".join(frame.columns))
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r))


def _version_meta(context: Context, note: str) -> Callable:
    def text(manifest, own) -> str:
        return notes.version_note(
            manifest,
            [tuple(r) for r in reads.composition(own).orderBy("original_set", "batch_version").collect()],
            [tuple(r) for r in reads.target_mappings(own).orderBy("target").collect()],
            [(r["target"], r["positive"], r["negative"], r["unknown"], r["boxes"]) for r in reads.category_distribution(own).orderBy("target").collect()],
            note,
        )

    return text


def do_ls(c: Context, a: argparse.Namespace) -> None:
    if a.what in ("manual-sets", "history"):
        for m in c.store.versions()[: a.limit]:
            print(f"{m['name']}@{m['version']}\t{m['created_at']}\t{m['created_by']}\t{json.dumps(m['counts'])}")
        return
    frames = {"sets": reads.original_sets, "batches": lambda k: reads.batches(k, a.set), "categories": reads.categories, "annotators": reads.annotators}
    frame = frames[a.what](c.catalog)
    show(frame.orderBy(frame.columns[0]), a.limit)


def do_lists(c: Context, a: argparse.Namespace) -> None:
    if a.action == "add":
        with open(a.arg, encoding="utf-8") as f:
            print(lists.register(c.spark, c.lists, f.read().splitlines(), a.arg))
    elif a.action == "show":
        print("\n".join(lists.fetch(c.catalog, a.arg)))
    else:
        show(lists.browse(c.spark, c.lists))


def do_validate(c: Context, a: argparse.Namespace) -> None:
    spec, state = c.spec(a.spec)
    print(f"{spec.fingerprint()} {len(spec.steps)} steps ({state})")


def do_build(c: Context, a: argparse.Namespace) -> None:
    spec, state = c.spec(a.spec)
    if state == "modified":
        print("warning: the stored specification was modified", file=sys.stderr)
    done, manifest = build(c.catalog, c.store, spec, a.name, a.version, Author.here(a.author, a.email), dry_run=a.dry_run, meta=_version_meta(c, a.note))
    for w in done.warnings:
        print(f"warning: {w}", file=sys.stderr)
    print(json.dumps(manifest["counts"] if manifest else done.final.counts()))


def do_show(c: Context, a: argparse.Namespace) -> None:
    own = reads.stored(c.catalog, c.store, *parse_ref(a.ref))
    print(json.dumps(c.store.manifest(*parse_ref(a.ref)), ensure_ascii=False))
    for frame in (reads.composition(own), reads.subjects_summary(own), reads.target_mappings(own), reads.category_distribution(own)):
        show(frame)


def do_spec(c: Context, a: argparse.Namespace) -> None:
    found = c.store.read_text(*parse_ref(a.ref), "spec.yaml")
    if found is None:
        raise SpecError(f"{a.ref} has no specification")
    if a.out:
        with open(a.out, "w", encoding="utf-8", newline="") as f:
            f.write(found)
    else:
        sys.stdout.write(found)


def do_image(c: Context, a: argparse.Namespace) -> None:
    print(json.dumps(reads.image_detail(c.catalog, reads.resolve_image(c.catalog, a.image), c.store), default=str, ensure_ascii=False, indent=1))


def do_why(c: Context, a: argparse.Namespace) -> None:
    spec, state = c.spec(a.ref)
    if state == "modified":
        print("warning: the stored specification was modified", file=sys.stderr)
    show(explain(run(c.catalog, spec), reads.resolve_image(c.catalog, a.image, lowest=True)))


def do_diff(c: Context, a: argparse.Namespace) -> None:
    old, new = (reads.stored(c.catalog, c.store, *parse_ref(r)) for r in (a.old, a.new))
    show(reads.diff_ids(old.images, new.images, "image_id"))
    show(reads.diff_ids(old.cls, new.cls, "ann_id"))
    show(reads.diff_annotations(old.cls, new.cls), reads.SHOWN)
    show(reads.diff_mapping(old.targets, new.targets))
    show(reads.diff_refs(c.catalog, old.images, new.images))


def do_leakage(c: Context, a: argparse.Namespace) -> None:
    refs = [a.left, a.right, *a.more]
    if len(refs) == 2:
        x, y = (reads.stored(c.catalog, c.store, *parse_ref(r)).images for r in refs)
        found = [reads.leakage_content(x, y), reads.leakage_subjects(x, y)]
    else:
        every = union_all([reads.stored(c.catalog, c.store, *parse_ref(r)).images.select(F.lit(r).alias("version"), "image_id", "blake3_hash", "subject_id") for r in refs])
        found = [reads.shared_content(every), reads.shared_subjects(every)]
    for f in found:
        show(f.orderBy(f.columns[0]), 50)
    if any(f.take(1) for f in found):
        raise SpecError("the versions share content or subjects")


def do_rm(c: Context, a: argparse.Namespace) -> None:
    name, _, version = a.ref.partition("@")
    for d in c.store.describe_deletion(name, version or None):
        print(json.dumps(d, ensure_ascii=False))
    if a.yes:
        print("removed", *c.store.delete(name, version or None))


def do_export(c: Context, a: argparse.Namespace) -> None:
    own = reads.stored(c.catalog, c.store, *parse_ref(a.ref))
    if a.format == "csv":
        sinks.write_csv(own, a.out)
    elif a.format == "parquet":
        sinks.write_layout(own, a.out)
    elif a.format == "coco-lines":
        sinks.write_coco_lines(own, a.out)
    elif a.format == "coco":
        with open(a.out, "w", encoding="utf-8") as f:
            f.writelines(sinks.coco_document(own, a.ref))
    else:
        with open(a.out, "wb") as f:
            f.write(sinks.bundle(own, c.store.read_text(*parse_ref(a.ref), "spec.yaml") or "", a.ref))


def do_check(c: Context, a: argparse.Namespace) -> None:
    frame = checks.source_checks(c.catalog)
    if a.ref:
        other = reads.stored(c.catalog, c.store, *parse_ref(a.other)) if a.other else None
        frame = checks.version_checks(reads.stored(c.catalog, c.store, *parse_ref(a.ref)), other, c.store.table(*parse_ref(a.ref), "targets"))
    show(frame.orderBy("seq"))
    for seq, name, n in checks.manifest_checks(c.store.versions()):
        print(f"{seq}\t{name}\t{n}")


FILES = ("images", "cls_annotations", "det_annotations", "categories", "annotators", "licenses")


def do_import(c: Context, a: argparse.Namespace) -> None:
    """A delivery directory for an existing batch SET@VERSION of the kind."""
    name, version = parse_ref(a.batch)
    batch = c.catalog.batch_id("image" if a.what == "images" else "annotation", name, version)
    if a.what == "images":
        got = ingest.image_batch(c.catalog, batch, c.spark.read.parquet(f"{a.folder}/images.parquet"), a.on_conflict)
    else:
        files = {f: c.spark.read.parquet(f"{a.folder}/{f}.parquet") for f in FILES if os.path.exists(f"{a.folder}/{f}.parquet")}
        got = ingest.annotation_batch(c.catalog, name, batch, files, a.on_missing, a.on_duplicate)
    for kind, reason, n in (tuple(r) for r in got.refused.groupBy("kind", "reason").count().orderBy("kind", "reason").limit(50).collect()):
        print(f"refused\t{kind}\t{n}\t{reason}")
    print(json.dumps(ingest.store(c.catalog, f"{c.root}/originals", got)))


def do_meta(c: Context, a: argparse.Namespace) -> None:
    """Notes about one batch, as Markdown."""
    name, version = parse_ref(a.batch)
    batch = c.catalog.batch_id("image" if a.what == "images" else "annotation", name, version)
    one = lambda frame, key: frame.where(F.col(key) == batch).drop(key)
    if a.what == "images":
        stats = one(reads.image_batch_stats(c.catalog), "image_batch_id").first()
        sizes = one(reads.image_sizes(c.catalog), "image_batch_id").orderBy(F.col("images").desc(), "width", "height").limit(20).collect()
        text = notes.images_note(a.batch, stats.asDict() if stats else {}, one(reads.suffixes(c.catalog), "image_batch_id").orderBy("suffix").collect(), sizes, a.note)
    else:
        stats = one(reads.annotation_batch_stats(c.catalog, batch), "annotation_batch_id").first()
        names = reads.categories(c.catalog, batch).select("category_id", "category")
        spread = names.join(reads.local_distribution(c.catalog, batch), "category_id", "left").orderBy("category").select("category", "positive", "negative", "unknown").collect()
        text = notes.annotations_note(a.batch, stats.asDict() if stats else {}, spread, a.note)
    sys.stdout.write(text)


def do_db(c: Context, a: argparse.Namespace) -> None:
    """Rows of each table of the warehouse, and the published versions."""
    for table in SCHEMAS:
        there = table in c.catalog.tables
        print(f"{table}\t{c.catalog.table(table).count() if there else 'absent'}")
    print(f"versions\t{len(c.store.versions())}")


def do_explore(c: Context, a: argparse.Namespace) -> None:
    Shell(Session(c.catalog, c.lists, lambda w: print(f"warning: {w}")), c.store).cmdloop()


COMMANDS: dict[str, tuple[Callable, list[tuple]]] = {
    "ls": (do_ls, [("what", {"choices": ["sets", "batches", "categories", "annotators", "manual-sets", "history"]}), ("--set", {}), ("--limit", {"type": int, "default": 200})]),
    "lists": (do_lists, [("action", {"choices": ["add", "ls", "show"]}), ("arg", {"nargs": "?"})]),
    "validate": (do_validate, [("spec", {})]),
    "build": (do_build, [("spec", {}), ("-m --name", {"required": True}), ("-v --version", {"required": True}), ("--author", {}), ("--email", {}), ("--note", {"default": ""}), ("--dry-run", {"action": "store_true"})]),
    "show": (do_show, [("ref", {})]),
    "spec": (do_spec, [("ref", {}), ("--out", {})]),
    "image": (do_image, [("image", {})]),
    "why": (do_why, [("ref", {}), ("image", {})]),
    "diff": (do_diff, [("old", {}), ("new", {})]),
    "check-leakage": (do_leakage, [("left", {}), ("right", {}), ("more", {"nargs": "*"})]),
    "rm": (do_rm, [("ref", {}), ("--yes", {"action": "store_true"})]),
    "export": (do_export, [("ref", {}), ("format", {"choices": ["csv", "parquet", "coco", "coco-lines", "zip"]}), ("out", {})]),
    "check": (do_check, [("ref", {"nargs": "?"}), ("other", {"nargs": "?"})]),
    "import": (do_import, [("what", {"choices": ["images", "annotations"]}), ("batch", {}), ("folder", {}), ("--on-conflict", {"choices": ["error", "skip", "overwrite"], "default": "error"}), ("--on-missing", {"choices": ["error", "skip"], "default": "error"}), ("--on-duplicate", {"choices": ["error", "skip"], "default": "error"})]),
    "meta": (do_meta, [("what", {"choices": ["images", "annotations"]}), ("batch", {}), ("--note", {"default": ""})]),
    "db": (do_db, [("what", {"choices": ["status"]})]),
    "explore": (do_explore, []),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnloom")
    top.add_argument("--root", default=os.environ.get("TARNLOOM_ROOT", "warehouse"))
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        p = sub.add_parser(name)
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)
    return top


def main(argv: list[str] | None = None, context: Context | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        COMMANDS[args.command][0](context or Context(args.root), args)
        return 0
    except Exception as error:
        if os.environ.get("TARNLOOM_DEBUG"):
            raise
        print(f"error: {' '.join(str(error).split())[:500]}", file=sys.stderr)
        return 1
    finally:
        if context is None:
            release()


class Shell(cmd.Cmd):
    """Verbs over a session; ``commit`` publishes, ``quit`` ends."""

    prompt = "tarnloom> "

    def __init__(self, session: Session, store: Store, **kwargs):
        super().__init__(**kwargs)
        self.session, self.store, self.debug = session, store, False

    def onecmd(self, line: str) -> bool:
        try:
            return super().onecmd(line)
        except Exception as error:
            if self.debug:
                raise
            print(f"error: {' '.join(str(error).split())[:500]}", file=self.stdout)
            return False

    def say(self, result) -> None:
        print(json.dumps(result.candidates.counts()), file=self.stdout)

    def table(self, frame, most: int = 50) -> None:
        print("\t".join(frame.columns), file=self.stdout)
        for r in frame.limit(most).collect():
            print("\t".join("" if v is None else str(v) for v in r), file=self.stdout)

    def kind_of(self, original_set: str, version: str, kind: str | None) -> dict:
        """image_batch or annotation_batch; a version that both axes have must be named by kind."""
        found = [k for k in ("image", "annotation") if self.session.catalog.batches(k).where(f"original_set = '{original_set}' and batch_version = '{version}'").take(1)]
        if kind is None and len(found) != 1:
            raise SpecError(f"{original_set}@{version} is " + ("both an image and an annotation batch; say which" if found else "no batch"))
        return {f"{kind or found[0]}_batch": version}

    def do_source(self, line):
        """source SET@VERSION [image|annotation]"""
        ref, *kind = shlex.split(line)
        name, version = parse_ref(ref)
        self.say(self.session.add_source(name, **self.kind_of(name, version, kind[0] if kind else None)))

    def do_import(self, line):
        """import SET@VERSION FILE"""
        ref, file = shlex.split(line)
        name, version = parse_ref(ref)
        with open(file, encoding="utf-8") as f:
            self.say(self.session.import_list(name, version, f.read().splitlines(), file))

    def do_pick(self, line):
        """pick FILE"""
        with open(line.strip(), encoding="utf-8") as f:
            self.say(self.session.pick(f.read().splitlines(), line.strip()))

    def do_split(self, line):
        """split MOD KEEP,KEEP SEED [KEY]"""
        mod, keep, seed, *key = shlex.split(line)
        self.say(self.session.split(int(mod), [int(k) for k in keep.split(",")], seed, *key))

    def do_balance(self, line):
        """balance MOST SEED [target|local]"""
        most, seed, *by = shlex.split(line)
        self.say(self.session.balance(int(most), seed, *by))

    def do_filter(self, line):
        """filter EXPRESSION"""
        self.say(self.session.filter(line))

    def do_annotated(self, line):
        """annotated"""
        self.say(self.session.keep_annotated_only())

    def do_duplicates(self, line):
        self.table(self.session.find_duplicates())

    def do_dedup(self, line):
        """dedup [SET,SET]"""
        self.say(self.session.dedup([s for s in line.strip().split(",") if s]))

    def do_union(self, line):
        """union [STEP STEP ...]"""
        self.say(self.session.union(shlex.split(line)))

    def do_intersect(self, line):
        """intersect [STEP STEP ...]"""
        self.say(self.session.intersect(shlex.split(line)))

    def do_except(self, line):
        """except [STEP STEP ...]"""
        self.say(self.session.exclude(shlex.split(line)))

    def do_categories(self, line):
        self.table(self.session.preview_categories())

    def do_map(self, line):
        """map SET@VERSION LOCAL TARGET"""
        scope, local, target = shlex.split(line)
        self.say(self.session.map_category({scope: {local: target}}))

    def do_merge_identical(self, line):
        self.say(self.session.merge_identical_category())

    def do_conflicts(self, line):
        self.table(self.session.conflict_summary())

    def do_resolve(self, line):
        """resolve score | annotator A,B | version V,V | manual ID"""
        how, *rest = shlex.split(line)
        names = rest[0].split(",") if rest else []
        s = self.session
        act = {"score": s.resolve_by_score, "annotator": lambda: s.resolve_by_annotator(names), "version": lambda: s.resolve_by_version(names), "manual": lambda: s.resolve_manual({int(n): "" for n in names})}
        if how not in act:
            raise SpecError(f"no way to resolve: {how}")
        self.say(act[how]())

    def do_exclude(self, line):
        """exclude IMAGE_ID [REASON]"""
        image, *reason = shlex.split(line)
        self.say(self.session.exclude_image(int(image), " ".join(reason)))

    def do_include(self, line):
        """include IMAGE_ID [REASON]"""
        image, *reason = shlex.split(line)
        self.say(self.session.override_one("include_image", image_id=int(image), reason=" ".join(reason)))

    def do_preview(self, line):
        self.table(self.session.preview())

    def do_steps(self, line):
        print("\n".join(self.session.describe()), file=self.stdout)

    def do_images(self, line):
        self.table(self.session.current.images.orderBy("image_id"), int(line or 20))

    def do_batches(self, line):
        self.table(reads.batches(self.session.catalog, line.strip() or None))

    def do_checkpoint(self, line):
        self.session.checkpoint(line.strip())

    def do_rollback(self, line):
        self.session.rollback(line.strip())

    def do_checkout(self, line):
        self.session.checkout(line.strip())

    def do_undo(self, line):
        self.session.undo()

    def do_spec(self, line):
        print(self.session.compile().dumps(), file=self.stdout)

    def do_save(self, line):
        """save FILE"""
        with open(line.strip(), "w", encoding="utf-8") as f:
            f.write(self.session.compile().dumps())

    def do_load(self, line):
        """load FILE"""
        with open(line.strip(), encoding="utf-8") as f:
            self.session.replay(Spec.loads(f.read()))

    def do_commit(self, line):
        """commit NAME VERSION"""
        name, version = shlex.split(line)
        _, manifest = self.session.commit(self.store, name, version, Author.here())
        print(json.dumps(manifest["counts"]), file=self.stdout)

    def do_debug(self, line):
        self.debug = line.strip() != "off"

    def do_quit(self, line):
        return True

    do_EOF = do_quit


if __name__ == "__main__":
    sys.exit(main())

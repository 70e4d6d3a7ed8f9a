"""Publishing immutable versions, and removing them.

A version is a directory ``<root>/<name>/<version>`` with its tables, the
specification, the notes and, written last, the manifest. Everything is written
to a staging directory first; who creates the version's claim, a file that can be
created only once, moves it into place. A directory without a manifest does not
exist for readers. A claim that a lost builder left behind is removed by
``delete``, like a version.
"""

from __future__ import annotations

import datetime
import getpass
import json
import os
import socket
import time
import uuid
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError
from ..operators import Candidates
from ..sources.catalog import Catalog
from ..spec import Spec
from .runner import Run, check, run

TABLES = ("images", "cls", "det", "targets", "mappings")


@dataclass(frozen=True)
class Author:
    name: str
    email: str

    @classmethod
    def here(cls, name: str | None = None, email: str | None = None) -> Author:
        """From the arguments, the environment, or the machine."""
        who = name or os.environ.get("TARNLOOM_AUTHOR") or getpass.getuser()
        mail = email or os.environ.get("TARNLOOM_EMAIL") or f"{getpass.getuser()}@{socket.gethostname()}"
        if "@" not in mail:
            raise SpecError(f"{mail!r} is no e-mail address")
        return cls(who, mail)


class Store:
    """The published versions under a root directory of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def at(self, name: str, version: str) -> str:
        for part in (name, version):
            if not part or "/" in part or part.startswith(("_", ".")):
                raise SpecError(f"{part!r} is no name for a set or version")
        return f"{self.root}/{name}/{version}"

    def read_text(self, *parts: str) -> str | None:
        path = self._path(*parts)
        if not self.fs.exists(path):
            return None
        size = self.fs.getFileStatus(path).getLen()
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode() if size else ""
        finally:
            stream.close()

    def write_text(self, content: str, *parts: str) -> None:
        stream = self.fs.create(self._path(*parts), True)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()

    def manifest(self, name: str, version: str) -> dict[str, Any] | None:
        found = self.read_text(name, version, "manifest.json")
        return json.loads(found) if found is not None else None

    def versions(self, name: str | None = None) -> list[dict[str, Any]]:
        """Manifests, newest first."""
        out = []
        root = self._path()
        if not self.fs.exists(root):
            return out
        for d in self.fs.listStatus(root):
            own = d.getPath().getName()
            if d.isDirectory() and not own.startswith("_") and name in (None, own):
                for v in self.fs.listStatus(d.getPath()):
                    if (m := self.manifest(own, v.getPath().getName())) is not None:
                        out.append(m)
        return sorted(out, key=lambda m: (m["created_at"], m["name"], m["version"]), reverse=True)

    def table(self, name: str, version: str, table: str) -> DataFrame:
        if self.manifest(name, version) is None:
            raise SpecError(f"no version {name}@{version}")
        return self.spark.read.parquet(f"{self.at(name, version)}/{table}")

    def spec(self, name: str, version: str) -> tuple[Spec | None, str]:
        """The stored specification and its state: ok, none, missing or modified."""
        m = self.manifest(name, version)
        if m is None:
            raise SpecError(f"no version {name}@{version}")
        if not m.get("spec_sha256"):
            return None, "none"
        stored = self.read_text(name, version, "spec.yaml")
        if stored is None:
            return None, "missing"
        spec = Spec.loads(stored)
        return spec, "ok" if spec.fingerprint() == m["spec_sha256"] else "modified"

    def claim(self, name: str, version: str, author: str) -> bool:
        """Whether this builder is the first to claim the version. A local file system needs its
        own call for it; Hadoop's looks first and creates then."""
        path = self._path(name, "_claims", version)
        self.fs.mkdirs(path.getParent())
        if self.fs.getUri().getScheme() == "file":
            if not self.jvm.java.io.File(path.toUri().getPath()).createNewFile():
                return False
            stream = self.fs.create(path, True)
        else:
            try:
                stream = self.fs.create(path, False)
            except Py4JJavaError:
                return False
        stream.write(bytearray(author.encode()))
        stream.close()
        return True

    def claimed_by(self, name: str, version: str) -> str | None:
        return self.read_text(name, "_claims", version)

    def unclaim(self, name: str, version: str) -> None:
        self.fs.delete(self._path(name, "_claims", version), False)

    def describe_deletion(self, name: str, version: str | None = None) -> list[dict[str, Any]]:
        doomed = [m for m in self.versions(name) if version in (None, m["version"])]
        if not doomed:
            raise SpecError(f"nothing to remove: {name}" + (f"@{version}" if version else ""))
        rest = [m for m in self.versions(name) if m not in doomed]
        steps = lambda m: len(spec.steps) if (spec := self.spec(m["name"], m["version"])[0]) else 0
        return [{**{k: m[k] for k in ("name", "version", "counts")}, "steps": steps(m), "removes_set": not rest} for m in doomed]

    def delete(self, name: str, version: str | None = None) -> list[str]:
        """Removes a version or all of a set; the manifest goes first, so readers never see half."""
        gone = []
        if version and self.manifest(name, version) is None and self.claimed_by(name, version) is not None:
            self.unclaim(name, version)
            return [f"the claim of {name}@{version}"]
        for d in self.describe_deletion(name, version):
            self.fs.delete(self._path(d["name"], d["version"], "manifest.json"), False)
            self.fs.delete(self._path(d["name"], d["version"]), True)
            self.unclaim(d["name"], d["version"])
            gone.append(f"{d['name']}@{d['version']}")
        if not self.versions(name):
            self.fs.delete(self._path(name), True)
        return gone


def parse_ref(ref: str) -> tuple[str, str]:
    """(name, version), split at the last @."""
    name, at, version = ref.rpartition("@")
    if not (at and name and version):
        raise SpecError(f"{ref!r} is not of the form name@version")
    return name, version


def tables(own: Candidates) -> dict[str, DataFrame]:
    """The stored tables: memberships by id, used targets, mappings of used categories."""
    used = own.used_categories().select("category_id")
    mappings = own.targets.join(used, "category_id", "left_semi")
    targets = mappings.select("target").distinct().orderBy("target")
    return {
        "images": own.images.select("image_id").distinct(),
        "cls": own.cls.select(F.col("ann_id").alias("cls_annotation_id"), "image_id").distinct(),
        "det": own.det.select(F.col("ann_id").alias("det_annotation_id"), "image_id").distinct(),
        "targets": targets,
        "mappings": mappings.distinct(),
    }


def _winner(store: Store, name: str, version: str) -> str:
    """Who published or claimed a version; a claim may be a moment old and still without its name."""
    for _ in range(20):
        if who := (store.manifest(name, version) or {}).get("created_by") or store.claimed_by(name, version):
            return who
        time.sleep(0.1)
    return "someone else"


def build(catalog: Catalog, store: Store, spec: Spec, name: str, version: str, author: Author, note: str = "", dry_run: bool = False, meta=None) -> tuple[Run, dict[str, Any] | None]:
    """Runs, checks and publishes. A failure leaves nothing visible; a version that appears
    meanwhile is an error that names its builder."""
    target = store.at(name, version)
    if (there := store.manifest(name, version)) is not None:
        raise SpecError(f"{name}@{version} exists; it was built by {there['created_by']} at {there['created_at']}")
    done = run(catalog, spec, keep_final=True)
    own = done.final
    check(own)
    if dry_run:
        return done, None
    staging, mine, moved = f"_staging/{uuid.uuid4().hex}", False, False
    try:
        for part, frame in tables(own).items():
            ordered = frame if part == "targets" else frame.sortWithinPartitions(frame.columns[0])
            ordered.write.parquet(f"{store.root}/{staging}/{part}")
        counts = {p: store.spark.read.parquet(f"{store.root}/{staging}/{p}").count() for p in TABLES}
        manifest = {
            "name": name,
            "version": version,
            "created_by": author.name,
            "email": author.email,
            "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
            "spec_sha256": spec.fingerprint(),
            "counts": counts,
            "warnings": done.warnings,
        }
        store.write_text(spec.dumps(), staging, "spec.yaml")
        store.write_text(meta(manifest, own) if meta else note, staging, "__meta__.md")
        store.write_text(json.dumps(manifest, ensure_ascii=False, indent=1), staging, "manifest.json")
        store.fs.mkdirs(store._path(name))
        mine = store.claim(name, version, author.name)
        if mine and not store.fs.exists(store._path(name, version)):
            moved = store.fs.rename(store._path(*staging.split("/")), store._path(name, version))
        if not moved:
            raise SpecError(f"{target} was just created by {_winner(store, name, version)}")
    finally:
        if mine and not moved:
            store.unclaim(name, version)
        staged = store._path(*staging.split("/"))
        if store.fs.exists(staged):
            store.fs.delete(staged, True)
    return done, manifest

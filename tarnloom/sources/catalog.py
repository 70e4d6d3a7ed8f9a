"""The read side of the warehouse: metadata tables and their denormalised frames.

All frames are lazy. Batch filters and column pruning reach the scans; small
dimension tables are broadcast only after their size is known.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.spread import listed, small

SCHEMAS: dict[str, str] = {
    "batches": "original_set_name string, batch_kind string, version string, batch_id long, created_at timestamp",
    "images": "id long, image_batch_id long, file_name string, height int, width int, blake3_hash string, license_id long, date_captured date",
    "image_subjects": "image_id long, subject_id string",
    "image_lineage": "parent_image_id long, child_image_id long",
    "licenses": "id long, name string, url string",
    "annotators": "id long, name string",
    "categories": "id long, annotation_batch_id long, name string, supercategory string",
    "cls_annotations": "id long, annotation_batch_id long, image_id long, category_id long, score double, annotator_id long",
    "det_annotations": "id long, annotation_batch_id long, image_id long, category_id long, bbox array<double>, segmentation string, iscrowd smallint, score double, annotator_id long",
    "import_lists": "sha256 string, file_names array<string>, source_note string, created_at timestamp",
}
IMAGE = ("image_id", "image_batch_id", "original_set", "batch_version", "file_name", "width", "height", "blake3_hash", "date_captured", "subject_id", "license_id")
HELD_BATCHES = 100_000
ANNOTATION = ("ann_id", "annotation_batch_id", "image_id", "category_id", "score", "annotator", "category", "original_set", "batch_version", "source")


class Catalog:
    """Tables by name; an absent optional table is empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.tables = tables
        self._nothing: dict[str, DataFrame] = {}
        self.written: list[DataFrame] = []  # frames that a run reads from its own tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Catalog:
        """Tables stored as ``path/<name>`` or ``path/<name>.parquet``; absent ones are empty."""
        from pyspark.errors import AnalysisException

        found = {}
        for name in names or SCHEMAS:
            for file in (f"{path}/{name}.parquet", f"{path}/{name}"):
                try:
                    found[name] = spark.read.parquet(file)
                    break
                except AnalysisException:
                    continue
        return cls(spark, found)

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return self.nothing(SCHEMAS[name])

    def nothing(self, schema: str) -> DataFrame:
        """No rows, in a form that the optimiser sees through: joins with it fall away."""
        if schema not in self._nothing:
            fields = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in T.StructType.fromDDL(schema))
            self._nothing[schema] = self.spark.sql(f"SELECT {fields} WHERE false")
        return self._nothing[schema]

    # dimensions

    def batches(self, kind: str) -> DataFrame:
        rows = self.table("batches").where(F.col("batch_kind") == kind)
        return rows.groupBy("batch_id").agg(F.max(F.struct("created_at", "original_set_name", "version")).alias("b")).select("batch_id", F.col("b.original_set_name").alias("original_set"), F.col("b.version").alias("batch_version"), "b.created_at")

    @cached_property
    def _held(self) -> list[tuple[str, int, str, str]] | None:
        """(kind, id, set, version) of every batch; None if they are too many to hold."""
        newest = F.max(F.struct("created_at", "original_set_name", "version")).alias("b")
        rows = self.table("batches").groupBy("batch_kind", "batch_id").agg(newest).select("batch_kind", "batch_id", "b.original_set_name", "b.version").limit(HELD_BATCHES + 1).collect()
        return [tuple(r) for r in rows] if len(rows) <= HELD_BATCHES else None

    @cached_property
    def _numbers(self) -> dict[tuple[str, str, str], int] | None:
        """Batch ids by (kind, set, version), the smallest of each; None if they are too many to hold."""
        if self._held is None:
            return None
        return {(kind, own, version): number for kind, number, own, version in sorted((r for r in self._held if r[1] is not None), key=lambda r: -r[1])}

    def _batch_names(self, kind: str, column: str) -> DataFrame:
        """(column, original_set, batch_version) of the batches of a kind, for joins."""
        if self._held is None:
            return small(self.batches(kind).select(F.col("batch_id").alias(column), "original_set", "batch_version"))
        return listed(self.spark, [r[1:] for r in self._held if r[0] == kind], f"{column} long, original_set string, batch_version string")

    def batch_id(self, kind: str, original_set: str, version: str) -> int:
        if self._numbers is not None:
            if (found := self._numbers.get((kind, original_set, version))) is None:
                raise SpecError(f"no {kind} batch {original_set}@{version}")
            return found
        row = self.batches(kind).where((F.col("original_set") == original_set) & (F.col("batch_version") == version)).select("batch_id").orderBy("batch_id").first()
        if row is None:
            raise SpecError(f"no {kind} batch {original_set}@{version}")
        return row[0]

    @cached_property
    def categories(self) -> DataFrame:
        """(category_id, annotation_batch_id, category, supercategory, source)."""
        own = self.table("categories").select(F.col("id").alias("category_id"), "annotation_batch_id", F.col("name").alias("category"), "supercategory").dropDuplicates(["category_id"])
        at = self.batches("annotation").select(F.col("batch_id").alias("annotation_batch_id"), F.concat_ws("@", "original_set", "batch_version").alias("source"))
        return own.join(small(at), "annotation_batch_id")

    # dimension frames as the fact frames join them; their size is counted once

    @cached_property
    def _image_batches(self) -> DataFrame:
        return self._batch_names("image", "image_batch_id")

    @cached_property
    def _annotation_batches(self) -> DataFrame:
        return self._batch_names("annotation", "annotation_batch_id")

    @cached_property
    def _annotators(self) -> DataFrame:
        return small(self.table("annotators").groupBy(F.col("id").alias("annotator_id")).agg(F.min("name").alias("annotator")))

    @cached_property
    def _category_names(self) -> DataFrame:
        return small(self.table("categories").groupBy(F.col("id").alias("category_id")).agg(F.min("name").alias("category")))

    # facts

    def image_ids(self, *batches: int) -> DataFrame:
        """(image_id) of batches."""
        return self.table("images").where(F.col("image_batch_id").isin(*batches)).select(F.col("id").alias("image_id"))

    def images(self, *batches: int) -> DataFrame:
        """Images with their batch, set and subject; of some batches if given."""
        own = self.table("images")
        if batches:
            own = own.where(F.col("image_batch_id").isin(*batches))
        own = own.select(F.col("id").alias("image_id"), "image_batch_id", "file_name", "width", "height", "blake3_hash", "date_captured", "license_id")
        people = self.table("image_subjects").groupBy("image_id").agg(F.min("subject_id").alias("subject_id"))
        return own.join(self._image_batches, "image_batch_id").join(people, "image_id", "left").select(*IMAGE)

    def annotations(self, kind: str, batch: int | None = None, on: DataFrame | None = None) -> DataFrame:
        """Annotations with annotator, category and batch, of one batch or on some images if
        given; rows delivered twice count once."""
        own = self.table(f"{kind}_annotations")
        if on is not None:  # before anything is shuffled by id
            own = own.join(on.select("image_id"), "image_id", "left_semi")
        if batch is not None:
            own = own.where(F.col("annotation_batch_id") == batch)
        extra = ["bbox", "segmentation", "iscrowd"] if kind == "det" else []
        own = own.withColumnRenamed("id", "ann_id").dropDuplicates(["ann_id"])
        joined = own.join(self._annotators, "annotator_id", "left").join(self._annotation_batches, "annotation_batch_id").join(self._category_names, "category_id", "left")
        return joined.withColumn("source", F.concat_ws("@", "original_set", "batch_version")).select(*ANNOTATION, *extra)

"""One query for each operator over the delivered tables, with the SQL that says the same.

The delivered tables play the warehouse: ``batches`` is the batch view, hashes
are brought to one form first, and every row counts. ``whole`` is the candidate
set of everything; a category's target is its own name, or its supercategory
where few classes are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import with_hex
from ..operators import OPERATORS, Candidates
from ..operators import conflicts as conflicts_
from ..operators.base import TARGETS, bucket, subject_key
from ..operators.dedup import find_duplicates
from ..operators.filters import label_context
from ..operators.mapping import category_report
from ..sources import sinks
from ..sources.catalog import Catalog
from ..spec import Spec, Step
from . import checks, reads
from .runner import run

NAMES = ["batches", "images", "image_subjects", "image_lineage", "annotators", "categories", "cls_annotations"]
SET, VERSION = "norvik_cxr", "V1"
LISTED = [f"{p}_{i:09d}.{e}" for i in range(1, 401) for p in ("lmn", "alb", "nvk") for e in ("jpg", "png")]
PRIORITY = ["ibex_portable", "bramblecot", "alderbay"]
VERSIONS = ["V5", "V4", "V3", "V2", "V1"]
READERS = [f"reader_{w}_{n:02d}" for n in range(1, 61) for w in ("quartz", "kilo", "nova", "umbra")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = Catalog(spark, {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES})
    images = c.tables["images"]
    c.tables["images"] = with_hex(images, "blake3_hash", 64, "_h").withColumn("blake3_hash", F.col("_h")).select(images.columns)
    return c


def whole(c: Catalog, by: str | None = None) -> Candidates:
    """Everything; ``by`` name or supercategory gives targets."""
    own = Candidates(c.images(), c.annotations("cls"), c.annotations("det"), c.nothing(TARGETS))
    if by:
        column = F.col("category") if by == "name" else F.lower(F.coalesce("supercategory", F.lit("none")))
        own = own.with_(targets=c.categories.select("category_id", column.alias("target")))
    return own


def step(op: str, **params) -> Step:
    inputs = {"inputs": ["a", "b"]} if op in ("union", "intersect", "except") else {} if op in ("source", "import_list") else {"input": "a"}
    return Step.parse({"id": "s", "op": op, **inputs, **params})


def apply(c: Catalog, own: Candidates | list[Candidates], op: str, **params) -> Candidates:
    return OPERATORS[op](c, own if isinstance(own, list) else [own], step(op, **params)).candidates


_X = r"regexp_replace(regexp_replace(regexp_replace(lower(blake3_hash), '[\s\p{Z}\p{Cf}]+', '', 'g'), '^(blake3[:=]|0x)', ''), '[:_.-]+', '', 'g')"
BASE = f"""hx AS (SELECT *, {_X} AS x FROM images),
im AS (SELECT h.id AS image_id, h.image_batch_id, h.file_name, h.height, h.width, CASE WHEN regexp_full_match(x, '[0-9a-f]{{64}}') AND x <> repeat(left(x, 1), 64) THEN x END AS blake3_hash,
  h.license_id, h.date_captured, b.original_set_name AS original_set, b.version AS batch_version, s.subject_id
  FROM hx h JOIN batches b ON b.batch_kind = 'image' AND b.batch_id = h.image_batch_id
  LEFT JOIN (SELECT image_id, min(subject_id) AS subject_id FROM image_subjects GROUP BY image_id) s ON s.image_id = h.id),
an AS (SELECT DISTINCT l.id AS ann_id, l.annotation_batch_id, l.image_id, l.category_id, l.score, a.name AS annotator, c.name AS category, lower(coalesce(c.supercategory, 'none')) AS family,
  b.version AS batch_version, b.original_set_name || '@' || b.version AS source
  FROM cls_annotations l LEFT JOIN annotators a ON a.id = l.annotator_id JOIN batches b ON b.batch_kind = 'annotation' AND b.batch_id = l.annotation_batch_id LEFT JOIN categories c ON c.id = l.category_id)"""


def query(sql: str | None):
    """Registers a query over (catalog, sf_dir) with its SQL; ``im`` and ``an`` are the frames of whole()."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(catalog(spark, sf_dir))
        if sql is not None:
            head, rest = ("WITH RECURSIVE", "," + sql[14:]) if sql.startswith("WITH RECURSIVE ") else ("WITH", "," + sql[5:] if sql.startswith("WITH ") else " " + sql)
            SQL[f.__name__] = f"{head} {BASE}{rest}"
        return f

    return add


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# sources


@query("SELECT image_id, file_name, width, height, subject_id, batch_version FROM im")
def scan_images(c):
    return whole(c).images.select("image_id", "file_name", "width", "height", "subject_id", "batch_version")


@query("SELECT ann_id, image_id, category, annotator, source, score FROM an")
def scan_annotations(c):
    return whole(c).cls.select("ann_id", "image_id", "category", "annotator", "source", "score")


@query(f"SELECT an.ann_id, an.image_id FROM an JOIN im USING (image_id) WHERE im.original_set = '{SET}' AND im.batch_version = '{VERSION}'")
def source_image_batch(c):
    return apply(c, [], "source", original_set=SET, image_batch=VERSION).cls.select("ann_id", "image_id")


@query(f"SELECT im.image_id, im.original_set FROM im WHERE image_id IN (SELECT image_id FROM an WHERE source = '{SET}@{VERSION}')")
def source_annotation_batch(c):
    return apply(c, [], "source", original_set=SET, annotation_batch=VERSION).images.select("image_id", "original_set")


@query(f"SELECT image_id, file_name FROM im WHERE original_set = 'lumen_er' AND batch_version = 'V1' AND file_name IN ({_in(LISTED)})")
def import_list(c):
    return apply(c, [], "import_list", original_set="lumen_er", image_batch="V1", file_names=LISTED, on_missing="ignore").images.select("image_id", "file_name")


# sets


def _parts(c) -> list[Candidates]:
    own = whole(c)
    recent = apply(c, own, "filter", criterion="predicate", expression="date_captured >= '2021-01-01'")
    large = apply(c, own, "filter", criterion="predicate", expression="width > 2500 or height > 2500")
    return [recent, large]


_RECENT, _LARGE = "coalesce(date_captured >= DATE '2021-01-01', false)", "(width > 2500 OR height > 2500)"


@query(f"SELECT image_id FROM im WHERE {_RECENT} OR {_LARGE}")
def union_images(c):
    return apply(c, _parts(c), "union").images.select("image_id")


@query(f"SELECT ann_id FROM an WHERE image_id IN (SELECT image_id FROM im WHERE {_RECENT} AND {_LARGE})")
def intersect_annotations(c):
    return apply(c, _parts(c), "intersect").cls.select("ann_id")


@query(f"SELECT image_id FROM im WHERE {_RECENT} AND NOT {_LARGE}")
def except_images(c):
    return apply(c, _parts(c), "except").images.select("image_id")


# filters


@query("SELECT image_id FROM im WHERE image_id IN (SELECT image_id FROM an)")
def filter_annotated(c):
    return apply(c, whole(c), "filter", criterion="annotated").images.select("image_id")


def _sample(key: str):
    def f(c):
        return apply(c, whole(c), "filter", criterion="sample", mod=4, keep_remainder=[0, 1, 2], seed="tarnloom", key_field=key).images.select("image_id")

    f.__name__ = f"filter_sample_{key}"
    sql_key = {"subject_id": "CASE WHEN subject_id <> '' THEN subject_id ELSE '__image__' || image_id END", "image_id": "image_id::VARCHAR", "file_name": "file_name"}[key]
    query(f"SELECT image_id FROM im WHERE ('0x' || substr(sha256('tarnloom' || chr(0) || ({sql_key})), 1, 16))::UBIGINT % 4 IN (0, 1, 2)")(f)


for _key in ("subject_id", "image_id", "file_name"):
    _sample(_key)


@query("SELECT image_id, (('0x' || substr(sha256('s' || chr(0) || (CASE WHEN subject_id <> '' THEN subject_id ELSE '__image__' || image_id END)), 1, 16))::UBIGINT % 1000)::BIGINT AS bucket FROM im")
def hash_bucket(c):
    return whole(c).images.select("image_id", bucket("s", subject_key(), 1000).alias("bucket"))


def _predicate(name: str, expression: str, sql: str):
    def f(c):
        return apply(c, whole(c, "name"), "filter", criterion="predicate", expression=expression).images.select("image_id")

    f.__name__ = f"filter_predicate_{name}"
    query(sql)(f)


_predicate("fields", "1000 <= width <= 2600 and original_set in ['alderbay', 'lumen_er'] and not height < 2000", "SELECT image_id FROM im WHERE width BETWEEN 1000 AND 2600 AND original_set IN ('alderbay', 'lumen_er') AND NOT height < 2000")
_predicate("nulls", "subject_id is None or date_captured != '2020-03-11' and blake3_hash is not None", "SELECT image_id FROM im WHERE subject_id IS NULL OR (date_captured IS DISTINCT FROM DATE '2020-03-11' AND blake3_hash IS NOT NULL)")
_predicate("labels", "'Pneumonia' in labels or n_annotations > 8", "SELECT image_id FROM im LEFT JOIN (SELECT image_id, count(*) AS n, bool_or(category = 'Pneumonia') AS p FROM an GROUP BY image_id) USING (image_id) WHERE p OR n > 8")
_predicate("regex", "regex(file_name, '^(alb|lmn)_0*[0-9]{1,4}[.](png|dcm)$') and 'lmn' in file_name", "SELECT image_id FROM im WHERE regexp_matches(file_name, '^(alb|lmn)_0*[0-9]{1,4}[.](png|dcm)$') AND contains(file_name, 'lmn')")


@query(f"SELECT image_id FROM im WHERE file_name IN ({_in(LISTED)})")
def filter_explicit_list(c):
    return apply(c, whole(c), "filter", criterion="explicit_list", file_names=LISTED, on_missing="ignore").images.select("image_id")


@query("""WITH RECURSIVE member AS (SELECT image_id, family, ('0x' || substr(sha256('even' || chr(0) || image_id), 1, 16))::UBIGINT % 4294967296 AS bucket FROM (SELECT DISTINCT image_id, family FROM an WHERE image_id IN (SELECT image_id FROM im))),
sizes AS (SELECT family, count(*) AS n, row_number() OVER (ORDER BY count(*), family) AS turn FROM member GROUP BY family),
turns AS (SELECT turn, n, image_id, bucket FROM member JOIN sizes USING (family)),
step AS (
  SELECT 0::BIGINT AS turn, []::BIGINT[] AS kept
  UNION ALL
  SELECT step.turn + 1, list_concat(kept, (SELECT coalesce(list(image_id), []) FROM (
      SELECT t.image_id, row_number() OVER (ORDER BY t.bucket, t.image_id) AS place, t.n,
        (SELECT count(*) FROM turns u WHERE u.turn = step.turn + 1 AND list_contains(kept, u.image_id)) AS have
      FROM turns t WHERE t.turn = step.turn + 1 AND NOT list_contains(kept, t.image_id)) WHERE n <= 2000 OR place + have <= 2000))
  FROM step WHERE step.turn < (SELECT max(turn) FROM sizes))
SELECT DISTINCT unnest(kept) AS image_id FROM step""")
def filter_balance(c):
    return apply(c, whole(c, "family"), "filter", criterion="balance", max_per_class=2000, seed="even").images.select("image_id")


@query("""SELECT image_id, coalesce(l, '') AS labels, coalesce(a, '') AS annotators, coalesce(n, 0) AS n_annotations FROM im LEFT JOIN (
  SELECT image_id, array_to_string(list_sort(list(DISTINCT category)), '|') AS l, array_to_string(list_sort(list(DISTINCT annotator)), '|') AS a, count(*) AS n FROM an GROUP BY image_id) USING (image_id)""")
def label_lists(c):
    return label_context(whole(c)).select("image_id", F.array_join("labels", "|").alias("labels"), F.array_join("annotators", "|").alias("annotators"), "n_annotations")


# duplicates

_RANKED = """SELECT image_id FROM (SELECT im.image_id, blake3_hash, row_number() OVER (PARTITION BY blake3_hash ORDER BY {order}) AS n FROM im
  LEFT JOIN (SELECT DISTINCT image_id, 1 AS noted FROM an) USING (image_id)) WHERE n = 1 OR blake3_hash IS NULL"""
_PLACE = "CASE original_set " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PRIORITY)) + " ELSE 3 END"


@query(_RANKED.format(order=f"{_PLACE}, image_id"))
def dedup_priority(c):
    return apply(c, whole(c), "dedup", source_priority=PRIORITY, prefer_annotated=False).images.select("image_id")


@query(_RANKED.format(order=f"coalesce(noted, 0) DESC, {_PLACE}, image_id"))
def dedup_prefer_annotated(c):
    return apply(c, whole(c), "dedup", source_priority=PRIORITY).images.select("image_id")


@query("""SELECT blake3_hash, array_to_string(list_sort(list(image_id)), ',') AS image_ids, array_to_string(list_sort(list(DISTINCT original_set || '@' || batch_version)), '|') AS sources,
  coalesce(sum(n), 0)::BIGINT AS annotations, count(DISTINCT original_set || '@' || batch_version) > 1 AS cross_source
  FROM im LEFT JOIN (SELECT image_id, count(*) AS n FROM an GROUP BY image_id) USING (image_id) WHERE blake3_hash IS NOT NULL GROUP BY blake3_hash HAVING count(*) > 1""")
def duplicate_groups(c):
    return find_duplicates(whole(c)).select("blake3_hash", F.array_join("image_ids", ",").alias("image_ids"), F.array_join("sources", "|").alias("sources"), "annotations", "cross_source")


# categories


@query("SELECT DISTINCT c.id AS category_id, c.name AS target FROM categories c WHERE c.id IN (SELECT category_id FROM an)")
def category_map_merge_identical(c):
    return apply(c, whole(c), "category_map", merge_identical=True).targets


SCOPES = [f"{s}@{v}" for s in (SET, "alderbay", "bramblecot", "kestrel_reads", "lumen_er", "sunhollow") for v in VERSIONS]


@query(f"SELECT ann_id, lower(category) AS target FROM an WHERE source IN ({_in(SCOPES)}) AND category IN ('Pneumonia', 'Normal', 'Fibrosis')")
def category_map_explicit(c):
    names = {n: n.lower() for n in ("Pneumonia", "Normal", "Fibrosis")}
    return apply(c, whole(c), "category_map", mapping=dict.fromkeys(SCOPES, names), require_total=False).mapped("cls").select("ann_id", "target")


@query("SELECT source, category, category AS target, count(*) AS annotations FROM an GROUP BY source, category")
def categories_in_use(c):
    return category_report(whole(c, "name"))


# conflicts

_BATCHES = """WITH bt AS (SELECT image_id, annotation_batch_id, max(source) AS source, max(batch_version) AS batch_version, array_to_string(list_sort(list(DISTINCT category)), chr(31)) AS targets, max(coalesce(score, 0)) AS top, list(DISTINCT annotator) AS people FROM an GROUP BY image_id, annotation_batch_id),
several AS (SELECT image_id FROM bt GROUP BY image_id HAVING count(*) > 1)"""


@query(_BATCHES + " SELECT image_id, CASE WHEN count(DISTINCT targets) > 1 THEN 'contradiction' ELSE 'duplicate' END AS kind, count(*) AS batches, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM bt GROUP BY image_id HAVING count(*) > 1")
def find_conflicts(c):
    return conflicts_.find_conflicts(whole(c, "name")).select("image_id", "kind", "batches", F.array_join("sources", "|").alias("sources"))


def _settled(name: str, rule: dict, score: str):
    def f(c):
        return conflicts_.winners(whole(c, "name"), [{"annotator_precedence": None, "version_precedence": None, "decisions": None, **rule}], c).select("image_id", "winner")

    f.__name__ = f"resolve_{name}"
    query(
        _BATCHES
        + f""", scored AS (SELECT image_id, annotation_batch_id, {score} AS s FROM bt WHERE image_id IN (SELECT image_id FROM several)),
best AS (SELECT image_id, min(s) AS m FROM scored WHERE s IS NOT NULL GROUP BY image_id),
won AS (SELECT image_id, min(annotation_batch_id) AS winner FROM scored JOIN best USING (image_id) WHERE s = m GROUP BY image_id HAVING count(*) = 1)
SELECT s.image_id, w.winner FROM several s LEFT JOIN won w USING (image_id)"""
    )(f)


_settled("score", {"rule": "highest_score"}, "-top")
_settled("version", {"rule": "batch_version_precedence", "version_precedence": VERSIONS}, "CASE batch_version " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(VERSIONS)) + " END")
_settled("annotator", {"rule": "annotator_precedence", "annotator_precedence": READERS}, f"(SELECT min(list_position([{_in(READERS)}], p)) FROM unnest(people) t(p) WHERE list_position([{_in(READERS)}], p) > 0)")


@query("SELECT ann_id FROM (SELECT ann_id, row_number() OVER (PARTITION BY image_id, category ORDER BY coalesce(score, 0) DESC, ann_id) AS n FROM an) WHERE n = 1")
def same_target_collapse(c):
    own = whole(c, "name")
    return conflicts_.collapse(own.cls, own.targets)


@query("SELECT array_to_string(s, ' vs ') AS pair, kind, count(*) AS images FROM (SELECT image_id, list_sort(list(DISTINCT source)) AS s, CASE WHEN count(DISTINCT t) > 1 THEN 'contradiction' ELSE 'duplicate' END AS kind FROM (SELECT image_id, annotation_batch_id, max(source) AS source, array_to_string(list_sort(list(DISTINCT category)), chr(31)) AS t FROM an GROUP BY image_id, annotation_batch_id) GROUP BY image_id HAVING count(*) > 1) GROUP BY ALL")
def conflict_pairs(c):
    return reads.conflict_pairs(whole(c, "name"))


@query("SELECT image_id FROM im WHERE image_id NOT IN (1, 2)")
def override_images(c):
    todo = [{"action": "exclude_image", "image_id": i} for i in (1, 2, 3)] + [{"action": "include_image", "image_id": 3}]
    return apply(c, whole(c), "manual_override", overrides=todo).images.select("image_id")


# listings and statistics


@query("""SELECT original_set_name AS original_set, count(DISTINCT batch_id) FILTER (WHERE batch_kind = 'image') AS image_batches, count(DISTINCT batch_id) FILTER (WHERE batch_kind = 'annotation') AS annotation_batches,
  coalesce((SELECT count(*) FROM im WHERE im.original_set = b.original_set_name), 0)::BIGINT AS images FROM batches b GROUP BY original_set_name""")
def list_sets(c):
    return reads.original_sets(c)


@query("""SELECT original_set_name AS original_set, batch_kind, version, batch_id,
  coalesce(CASE WHEN batch_kind = 'image' THEN i.n ELSE a.n END, 0) AS items, CASE WHEN batch_kind = 'image' THEN 0 ELSE coalesce(k.n, 0) END AS categories
  FROM batches b LEFT JOIN (SELECT image_batch_id, count(*) AS n FROM images GROUP BY 1) i ON i.image_batch_id = b.batch_id
  LEFT JOIN (SELECT annotation_batch_id, count(*) AS n FROM an GROUP BY 1) a ON a.annotation_batch_id = b.batch_id
  LEFT JOIN (SELECT annotation_batch_id, count(DISTINCT id) AS n FROM categories GROUP BY 1) k ON k.annotation_batch_id = b.batch_id""")
def list_batches(c):
    return reads.batches(c)


@query("SELECT b.original_set_name || '@' || b.version AS source, c.id AS category_id, c.name AS category, supercategory FROM categories c JOIN batches b ON b.batch_kind = 'annotation' AND b.batch_id = c.annotation_batch_id")
def list_categories(c):
    return reads.categories(c).drop("annotation_batch_id")


@query("SELECT id AS annotator_id, name, coalesce(n, 0) AS cls_annotations, 0::BIGINT AS det_annotations FROM annotators LEFT JOIN (SELECT annotator_id, count(*) AS n FROM (SELECT DISTINCT id, annotator_id FROM cls_annotations) GROUP BY 1) x ON x.annotator_id = annotators.id")
def list_annotators(c):
    return reads.annotators(c)


@query("SELECT annotation_batch_id, count(DISTINCT image_id) AS images, count(DISTINCT category_id) AS categories, count(DISTINCT a.id) AS annotators, count(DISTINCT i.license_id) AS licenses, count(DISTINCT ann_id) AS cls, 0::BIGINT AS det FROM an LEFT JOIN annotators a ON a.name = an.annotator LEFT JOIN images i ON i.id = an.image_id GROUP BY annotation_batch_id")
def annotation_batch_stats(c):
    return reads.annotation_batch_stats(c)


@query("""WITH t AS (SELECT annotation_batch_id, count(DISTINCT image_id) AS n FROM an GROUP BY 1)
SELECT category_id, count(DISTINCT image_id) FILTER (WHERE score > 0) AS positive, count(DISTINCT image_id) FILTER (WHERE score = 0) AS negative, max(t.n) - count(DISTINCT image_id) AS unknown FROM an JOIN t USING (annotation_batch_id) GROUP BY category_id""")
def local_distribution(c):
    return reads.local_distribution(c)


@query("SELECT image_batch_id, count(*) AS images, count(blake3_hash) AS with_hash, count(date_captured) AS with_date, count(license_id) AS with_license, count(DISTINCT nullif(subject_id, '')) AS subjects FROM im GROUP BY image_batch_id")
def image_batch_stats(c):
    return reads.image_batch_stats(c)


@query("SELECT image_batch_id, coalesce(nullif(lower(regexp_extract(file_name, '[^/](\\.[^./]+)$', 1)), ''), '(none)') AS suffix, count(*) AS images FROM im GROUP BY ALL")
def image_suffixes(c):
    return reads.suffixes(c)


@query("SELECT image_batch_id, width, height, count(*) AS images FROM im GROUP BY ALL")
def image_sizes(c):
    return reads.image_sizes(c)


@query("""WITH p AS (SELECT image_id, image_batch_id, file_name, row_number() OVER (PARTITION BY image_batch_id ORDER BY file_name, image_id) - 1 AS place, count(*) OVER (PARTITION BY image_batch_id) AS n FROM im)
SELECT image_id, image_batch_id, file_name FROM p WHERE EXISTS (SELECT 1 FROM range(50) t(i) WHERE i < least(50, n) AND place = i * n // least(50, n))""")
def image_even_sample(c):
    return reads.even_sample(whole(c).images, 50)


@query("SELECT original_set, batch_version, count(*) AS images FROM im GROUP BY ALL")
def version_composition(c):
    return reads.composition(whole(c))


@query("SELECT category AS target, count(*) AS annotations FROM an GROUP BY category")
def version_by_target(c):
    return reads.by_target(whole(c, "name"))


@query("SELECT count(DISTINCT s)::BIGINT AS subjects, coalesce(sum(n) FILTER (WHERE s IS NULL), 0)::BIGINT AS unknown, coalesce(max(n) FILTER (WHERE s IS NOT NULL), 0)::BIGINT AS most_per_subject FROM (SELECT nullif(subject_id, '') AS s, count(*) AS n FROM im GROUP BY 1)")
def version_subjects(c):
    return reads.subjects_summary(whole(c))


@query("SELECT family AS target, array_to_string(list_sort(list(DISTINCT source || ':' || category)), '|') AS categories FROM an GROUP BY family")
def target_mappings(c):
    return reads.target_mappings(whole(c, "family"))


@query("""WITH t AS (SELECT family AS target, count(DISTINCT image_id) FILTER (WHERE score > 0) AS positive, count(DISTINCT image_id) FILTER (WHERE score = 0) AS negative, count(DISTINCT image_id) AS a FROM an GROUP BY family),
names AS (SELECT DISTINCT lower(coalesce(supercategory, 'none')) AS target FROM categories)
SELECT target, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, (SELECT count(*) FROM im) - coalesce(a, 0) AS unknown, 0::BIGINT AS boxes_positive, 0::BIGINT AS boxes_no_score, 0::BIGINT AS boxes FROM names LEFT JOIN t USING (target)""")
def category_distribution(c):
    return reads.category_distribution(whole(c, "family"))


@query("""WITH sz AS (SELECT 'size' AS section, width || 'x' || height AS name, count(*) AS n FROM im GROUP BY 2 ORDER BY n DESC, name LIMIT 5)
SELECT 'source' AS section, original_set || '@' || batch_version AS name, count(*) AS n FROM im GROUP BY 2
UNION ALL SELECT 'local', category, count(*) FROM an GROUP BY 2 UNION ALL SELECT 'target', family, count(*) FROM an GROUP BY 2 UNION ALL SELECT 'annotator', annotator, count(*) FROM an WHERE annotator IS NOT NULL GROUP BY 2
UNION ALL SELECT * FROM sz UNION ALL SELECT 'coverage', 'annotated', count(DISTINCT image_id) FROM an UNION ALL SELECT 'coverage', 'unmapped', count(*) FROM an WHERE family IS NULL
UNION ALL SELECT 'subjects', 'known', count(DISTINCT nullif(subject_id, '')) FROM im UNION ALL SELECT 'subjects', 'images without', count(*) FROM im WHERE coalesce(subject_id, '') = ''
UNION ALL SELECT 'subjects', 'most images', coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM im WHERE subject_id <> '' GROUP BY subject_id)
UNION ALL SELECT 'year', coalesce(strftime(date_captured, '%Y'), 'none'), count(*) FROM im GROUP BY 2""")
def preview_summary(c):
    return reads.preview(whole(c, "family"))


# comparisons: the splits of manual_set_images


def _split(c: Catalog, sf_dir: str, version: int) -> DataFrame:
    ids = c.spark.read.parquet(f"{sf_dir}/manual_set_images.parquet").where(F.col("manual_set_version_id") == version).select("image_id").distinct()
    return whole(c).images.join(ids, "image_id", "left_semi")


def split_query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(catalog(spark, sf_dir), sf_dir)
        SQL[f.__name__] = f"WITH {BASE}, a AS (SELECT * FROM im WHERE image_id IN (SELECT image_id FROM manual_set_images WHERE manual_set_version_id = 101)), b AS (SELECT * FROM im WHERE image_id IN (SELECT image_id FROM manual_set_images WHERE manual_set_version_id = 102)) {sql}"
        return f

    return add


@split_query("SELECT blake3_hash, x.n AS left_images, y.n AS right_images FROM (SELECT blake3_hash, count(*) AS n FROM a WHERE blake3_hash IS NOT NULL GROUP BY 1) x JOIN (SELECT blake3_hash, count(*) AS n FROM b GROUP BY 1) y USING (blake3_hash)")
def leakage_content(c, d):
    return reads.leakage_content(_split(c, d, 101), _split(c, d, 102))


@split_query("SELECT subject_id, x.n AS left_images, y.n AS right_images FROM (SELECT subject_id, count(*) AS n FROM a WHERE subject_id <> '' GROUP BY 1) x JOIN (SELECT subject_id, count(*) AS n FROM b GROUP BY 1) y USING (subject_id)")
def leakage_subjects(c, d):
    return reads.leakage_subjects(_split(c, d, 101), _split(c, d, 102))


def _versions(c: Catalog, sf_dir: str) -> DataFrame:
    """All splits: (version, image_id, blake3_hash, subject_id)."""
    members = c.spark.read.parquet(f"{sf_dir}/manual_set_images.parquet").select(F.col("manual_set_version_id").alias("version"), "image_id").distinct()
    return members.join(whole(c).images, "image_id").select("version", "image_id", "blake3_hash", "subject_id")


_MEMBERS = "v AS (SELECT DISTINCT manual_set_version_id AS version, im.image_id, blake3_hash, subject_id FROM manual_set_images m JOIN im USING (image_id))"


@split_query(f", {_MEMBERS} SELECT blake3_hash, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, array_to_string(list_sort(list(DISTINCT image_id)), ',') AS image_ids, coalesce(array_to_string(list_sort(list(DISTINCT subject_id)), ','), '') AS subjects FROM v WHERE blake3_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT version) > 1")
def shared_content(c, d):
    return reads.shared_content(_versions(c, d))


@split_query(f", {_MEMBERS} SELECT subject_id, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions, array_to_string(list_sort(list(DISTINCT image_id)), ',') AS image_ids FROM v WHERE subject_id <> '' GROUP BY 1 HAVING count(DISTINCT version) > 1")
def shared_subjects(c, d):
    return reads.shared_subjects(_versions(c, d))


@split_query("""SELECT 'added' AS change, ref FROM (SELECT original_set || '/' || batch_version || '/' || file_name AS ref FROM b WHERE image_id NOT IN (SELECT image_id FROM a) ORDER BY ref LIMIT 20)
UNION ALL SELECT 'removed', ref FROM (SELECT original_set || '/' || batch_version || '/' || file_name AS ref FROM a WHERE image_id NOT IN (SELECT image_id FROM b) ORDER BY ref LIMIT 20)""")
def diff_refs(c, d):
    return reads.diff_refs(c, _split(c, d, 101), _split(c, d, 102))


@split_query("SELECT CASE WHEN a.image_id IS NULL THEN 'added' WHEN b.image_id IS NULL THEN 'removed' ELSE 'unchanged' END AS change, count(*) AS n FROM a FULL JOIN b ON a.image_id = b.image_id GROUP BY 1")
def diff_images(c, d):
    return reads.diff_ids(_split(c, d, 101), _split(c, d, 102), "image_id")


@query("""WITH o AS (SELECT image_id, array_to_string(list_sort(list(DISTINCT ann_id)), ',') AS x FROM an WHERE score > 0 GROUP BY 1), n AS (SELECT image_id, array_to_string(list_sort(list(DISTINCT ann_id)), ',') AS x FROM an WHERE score >= 0.5 GROUP BY 1)
SELECT image_id, coalesce(o.x, '') AS old_ids, coalesce(n.x, '') AS new_ids FROM o FULL JOIN n USING (image_id) WHERE coalesce(o.x, '') <> coalesce(n.x, '')""")
def diff_annotations(c):
    cls = whole(c).cls
    return reads.diff_annotations(cls.where("score > 0"), cls.where("score >= 0.5"))


@query("SELECT id AS category_id, name AS old_target, lower(coalesce(supercategory, 'none')) AS new_target FROM categories WHERE name IS DISTINCT FROM lower(coalesce(supercategory, 'none'))")
def diff_mapping(c):
    return reads.diff_mapping(whole(c, "name").targets, whole(c, "family").targets)


@query("SELECT DISTINCT child_image_id AS image_id, parent_image_id AS relative_id, 'parent' AS relation FROM image_lineage UNION ALL SELECT DISTINCT parent_image_id, child_image_id, 'child' FROM image_lineage")
def lineage_pairs(c):
    return reads.lineage(c)


# exports and checks


@query("""SELECT im.image_id, original_set || '/images/' || batch_version || '/' || file_name AS object_key, original_set, batch_version, file_name, width, height, subject_id, date_captured, blake3_hash, coalesce(l, '') AS labels, 0::BIGINT AS n_boxes
  FROM im LEFT JOIN (SELECT image_id, array_to_string(list_sort(list(family)), '|') AS l FROM an GROUP BY 1) USING (image_id)""")
def export_manifest(c):
    return sinks.manifest(whole(c, "family"))


@query("""WITH n AS (SELECT family, row_number() OVER (ORDER BY family) AS number FROM (SELECT DISTINCT family FROM an))
SELECT ann_id AS id, image_id, number AS category_id, score, annotator FROM an JOIN n USING (family)""")
def export_coco_labels(c):
    return sinks.coco(whole(c, "family"))["cls_annotations"]


@query("""SELECT 1 AS seq, count(*) AS violations FROM im WHERE NOT coalesce(width > 0 AND height > 0, false)
UNION ALL SELECT 3, count(*) FROM (SELECT 1 FROM im GROUP BY image_batch_id, file_name HAVING count(*) > 1)
UNION ALL SELECT 5, count(*) FROM cls_annotations WHERE image_id NOT IN (SELECT id FROM images)
UNION ALL SELECT 7, coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(DISTINCT id) AS n FROM cls_annotations GROUP BY annotation_batch_id, image_id, category_id, annotator_id, score)
UNION ALL SELECT 9, count(*) FROM categories WHERE id NOT IN (SELECT category_id FROM cls_annotations)
UNION ALL SELECT 10, count(*) FROM (SELECT 1 FROM categories GROUP BY annotation_batch_id, name HAVING count(*) > 1)""")
def integrity_checks(c):
    return checks.source_checks(c).where("seq in (1, 3, 5, 7, 9, 10)").select("seq", "violations")


@query("""SELECT 1 AS seq, count(*) AS violations FROM im WHERE NOT coalesce(width > 0 AND height > 0, false)
UNION ALL SELECT 2, count(*) FROM im WHERE blake3_hash IS NOT NULL AND NOT regexp_full_match(blake3_hash, '[0-9a-f]{64}')
UNION ALL SELECT 3, count(*) FROM (SELECT 1 FROM im GROUP BY image_batch_id, file_name HAVING count(*) > 1)
UNION ALL SELECT 4, count(*) FROM images i WHERE NOT EXISTS (SELECT 1 FROM batches b WHERE b.batch_kind = 'image' AND b.batch_id = i.image_batch_id)
UNION ALL SELECT 5, count(*) FROM cls_annotations WHERE image_id NOT IN (SELECT id FROM images)
UNION ALL SELECT 6, count(*) FROM cls_annotations l WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.id = l.category_id AND c.annotation_batch_id = l.annotation_batch_id)
UNION ALL SELECT 7, coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(DISTINCT id) AS n FROM cls_annotations GROUP BY annotation_batch_id, image_id, category_id, annotator_id, score)
UNION ALL SELECT 8, 0
UNION ALL SELECT 9, count(*) FROM categories WHERE id NOT IN (SELECT category_id FROM cls_annotations)
UNION ALL SELECT 10, count(*) FROM (SELECT 1 FROM categories GROUP BY annotation_batch_id, name HAVING count(*) > 1)
UNION ALL SELECT 11, 0
UNION ALL SELECT 12, count(*) FROM image_lineage a JOIN image_lineage b ON a.parent_image_id = b.child_image_id AND a.child_image_id = b.parent_image_id""")
def integrity_checks_all(c):
    return checks.source_checks(c).select("seq", "violations")


@split_query("""SELECT 1 AS seq, count(DISTINCT subject_id) AS violations FROM a WHERE subject_id <> '' AND subject_id IN (SELECT subject_id FROM b)
UNION ALL SELECT 2, count(DISTINCT blake3_hash) FROM a WHERE blake3_hash IN (SELECT blake3_hash FROM b)
UNION ALL SELECT 3, count(*) FROM (SELECT 1 FROM an WHERE image_id IN (SELECT image_id FROM a) GROUP BY image_id, family HAVING count(*) > 1)
UNION ALL SELECT 4, 0
UNION ALL SELECT 5, count(*) FROM (SELECT 1 FROM a WHERE blake3_hash IS NOT NULL GROUP BY blake3_hash HAVING count(*) > 1)
UNION ALL SELECT 6, count(*) FROM (SELECT DISTINCT lower(coalesce(supercategory, 'none')) AS f FROM categories) WHERE f NOT IN (SELECT family FROM an WHERE image_id IN (SELECT image_id FROM a) AND family IS NOT NULL)
UNION ALL SELECT 7, 0
UNION ALL SELECT 11, count(*) FROM a WHERE image_id NOT IN (SELECT image_id FROM an)
UNION ALL SELECT 14, 0""")
def integrity_checks_split(c, d):
    own = whole(c, "family")
    left, right = (own.keep_images(_split(c, d, v)) for v in (101, 102))
    return checks.version_checks(left, right).select("seq", "violations")


# boxes: no detections are delivered, so every classification gets one, from its image and category


def boxed(spark: SparkSession, sf_dir: str) -> Catalog:
    c = catalog(spark, sf_dir)
    x, y, w, h = [(F.lit(a) + F.col(k) % b).cast("double") for a, k, b in ((0, "image_id", 97), (0, "image_id", 89), (5, "category_id", 31), (7, "category_id", 29))]
    corners = F.concat_ws(",", x, y, x + w, y, x + w, y + h)
    outline = F.concat(F.when(F.col("category_id") % 2 == 0, "[[").otherwise("["), corners, F.when(F.col("category_id") % 2 == 0, "]]").otherwise("]"))
    score = F.when(F.col("image_id") % 5 != 0, F.col("score"))
    c.tables["det_annotations"] = c.table("cls_annotations").select("id", "annotation_batch_id", "image_id", "category_id", F.array(x, y, w, h).alias("bbox"), outline.alias("segmentation"), F.lit(0).cast("smallint").alias("iscrowd"), score.alias("score"), "annotator_id")
    return c


_BOX = "CASE WHEN image_id % 5 <> 0 THEN score END"


def box_query(sql: str):
    """A query over a catalog with boxes; ``bx`` are the annotations with their box's score as ``s``."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(boxed(spark, sf_dir))
        SQL[f.__name__] = f"WITH {BASE}, bx AS (SELECT *, {_BOX} AS s FROM an) {sql}"
        return f

    return add


@box_query(""", n AS (SELECT family, row_number() OVER (ORDER BY family) AS number FROM (SELECT DISTINCT family FROM an))
SELECT ann_id AS id, image_id, number AS category_id, (image_id % 97)::DOUBLE AS x, (image_id % 89)::DOUBLE AS y, (5 + category_id % 31)::DOUBLE AS w, (7 + category_id % 29)::DOUBLE AS h,
  ((5 + category_id % 31) * (7 + category_id % 29))::DOUBLE AS area, 1 AS outlines, (image_id % 89 + 7 + category_id % 29)::DOUBLE AS last, 0 AS iscrowd, s AS score, annotator FROM bx JOIN n USING (family)""")
def export_coco_boxes(c):
    box, outline = F.col("bbox"), F.col("segmentation")
    sides = [box[i].alias(k) for i, k in enumerate("xywh")]
    return sinks.coco(whole(c, "family"))["annotations"].select("id", "image_id", "category_id", *sides, "area", F.size(outline).alias("outlines"), outline[0][5].alias("last"), "iscrowd", "score", "annotator")


@box_query(""", t AS (SELECT family AS target, count(DISTINCT image_id) FILTER (WHERE score > 0) AS positive, count(DISTINCT image_id) FILTER (WHERE score = 0) AS negative, count(DISTINCT image_id) AS a,
  count(*) FILTER (WHERE s > 0) AS boxes_positive, count(*) FILTER (WHERE s IS NULL) AS boxes_no_score, count(*) AS boxes FROM bx GROUP BY family),
names AS (SELECT DISTINCT lower(coalesce(supercategory, 'none')) AS target FROM categories)
SELECT target, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, (SELECT count(*) FROM im) - coalesce(a, 0) AS unknown, coalesce(boxes_positive, 0) AS boxes_positive, coalesce(boxes_no_score, 0) AS boxes_no_score, coalesce(boxes, 0) AS boxes FROM names LEFT JOIN t USING (target)""")
def category_distribution_boxes(c):
    return reads.category_distribution(whole(c, "family"))


@box_query("""SELECT im.image_id, coalesce(l, '') AS labels, coalesce(n, 0) AS n_boxes
  FROM im LEFT JOIN (SELECT image_id, array_to_string(list_sort(list(family)), '|') AS l, count(*) AS n FROM bx GROUP BY 1) USING (image_id)""")
def export_manifest_boxes(c):
    return sinks.manifest(whole(c, "family")).select("image_id", "labels", "n_boxes")


@box_query(f"""SELECT 5 AS seq, 2 * count(*) AS violations FROM cls_annotations WHERE image_id NOT IN (SELECT id FROM images)
UNION ALL SELECT 6, 2 * count(*) FROM cls_annotations l WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.id = l.category_id AND c.annotation_batch_id = l.annotation_batch_id)
UNION ALL SELECT 7, coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(DISTINCT id) AS n FROM cls_annotations GROUP BY annotation_batch_id, image_id, category_id, annotator_id, score)
UNION ALL SELECT 8, coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(DISTINCT id) AS n FROM cls_annotations GROUP BY annotation_batch_id, image_id, category_id, annotator_id, {_BOX})
UNION ALL SELECT 9, count(*) FROM categories WHERE id NOT IN (SELECT category_id FROM cls_annotations)
UNION ALL SELECT 11, 0""")
def integrity_checks_boxes(c):
    return checks.source_checks(c).where("seq in (5, 6, 7, 8, 9, 11)").select("seq", "violations")  # those that look at annotations


# a whole specification

PIPELINE = Spec.parse(
    {
        "steps": [
            {"id": "images", "op": "source", "original_set": SET, "image_batch": VERSION},
            {"id": "more", "op": "source", "original_set": "alderbay", "image_batch": "V1"},
            {"id": "pool", "op": "union", "inputs": ["images", "more"]},
            {"id": "noted", "op": "filter", "input": "pool", "criterion": "annotated"},
            {"id": "once", "op": "dedup", "input": "noted", "source_priority": ["alderbay"]},
            {"id": "part", "op": "filter", "input": "once", "criterion": "sample", "mod": 4, "keep_remainder": [0, 1, 2], "seed": "pipeline"},
            {"id": "mapped", "op": "category_map", "input": "part", "merge_identical": True},
            {"id": "settled", "op": "conflict_resolve", "input": "mapped", "rules": [{"rule": "highest_score"}], "strict": False},
        ],
        "final": "settled",
    }
)


@query(f"""WITH pool AS (SELECT * FROM im WHERE (original_set, batch_version) IN (('{SET}', '{VERSION}'), ('alderbay', 'V1')) AND image_id IN (SELECT image_id FROM an)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blake3_hash ORDER BY CASE original_set WHEN 'alderbay' THEN 0 ELSE 1 END, image_id) AS n FROM pool) WHERE n = 1 OR blake3_hash IS NULL),
part AS (SELECT * FROM once WHERE ('0x' || substr(sha256('pipeline' || chr(0) || (CASE WHEN subject_id <> '' THEN subject_id ELSE '__image__' || image_id END)), 1, 16))::UBIGINT % 4 IN (0, 1, 2)),
l AS (SELECT * FROM an WHERE image_id IN (SELECT image_id FROM part)),
bt AS (SELECT image_id, annotation_batch_id, max(coalesce(score, 0)) AS top FROM l GROUP BY ALL),
won AS (SELECT image_id, max(annotation_batch_id) AS winner FROM (SELECT *, max(top) OVER (PARTITION BY image_id) AS best, count(*) OVER (PARTITION BY image_id) AS k FROM bt) WHERE k > 1 AND top = best GROUP BY image_id HAVING count(*) = 1),
kept AS (SELECT l.* FROM l LEFT JOIN won USING (image_id) WHERE winner IS NULL OR winner = l.annotation_batch_id)
SELECT ann_id, image_id, category AS target FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY coalesce(score, 0) DESC, ann_id) AS n FROM kept) WHERE n = 1""")
def build_pipeline(c):
    return run(c, PIPELINE).final.mapped("cls").select("ann_id", "image_id", "target")


# the same over every image batch
SETS = ["norvik_cxr", "alderbay", "tessen_lung", "quillon_tb", "marrowgate", "pellworth", "sunhollow", "kestrel_reads", "vantor_kids", "ibex_portable", "lumen_er", "bramblecot"]
_EVERY = [{"id": f"{s}_{v}", "op": "source", "original_set": s, "image_batch": v} for s in SETS for v in ("V1", "V2", "V3", "V4")]
PIPELINE_ALL = Spec.parse({"steps": [*_EVERY, {"id": "pool", "op": "union", "inputs": [x["id"] for x in _EVERY]}, *[s.plain() for s in PIPELINE.steps if s.id not in ("images", "more", "pool")]], "final": "settled"})


@query(f"""WITH pool AS (SELECT * FROM im WHERE image_id IN (SELECT image_id FROM an)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blake3_hash ORDER BY CASE original_set WHEN 'alderbay' THEN 0 ELSE 1 END, image_id) AS n FROM pool) WHERE n = 1 OR blake3_hash IS NULL),
part AS (SELECT * FROM once WHERE ('0x' || substr(sha256('pipeline' || chr(0) || (CASE WHEN subject_id <> '' THEN subject_id ELSE '__image__' || image_id END)), 1, 16))::UBIGINT % 4 IN (0, 1, 2)),
l AS (SELECT * FROM an WHERE image_id IN (SELECT image_id FROM part)),
bt AS (SELECT image_id, annotation_batch_id, max(coalesce(score, 0)) AS top FROM l GROUP BY ALL),
won AS (SELECT image_id, max(annotation_batch_id) AS winner FROM (SELECT *, max(top) OVER (PARTITION BY image_id) AS best, count(*) OVER (PARTITION BY image_id) AS k FROM bt) WHERE k > 1 AND top = best GROUP BY image_id HAVING count(*) = 1),
kept AS (SELECT l.* FROM l LEFT JOIN won USING (image_id) WHERE winner IS NULL OR winner = l.annotation_batch_id)
SELECT ann_id, image_id, category AS target FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category ORDER BY coalesce(score, 0) DESC, ann_id) AS n FROM kept) WHERE n = 1""")
def build_pipeline_all(c):
    return run(c, PIPELINE_ALL).final.mapped("cls").select("ann_id", "image_id", "target")

"""The p-queries and, where SQL can say the same on whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import cut
from . import consensus, lookalike, overlaps, packing, related, repeats, representative, tokens, vocabulary


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(*_t(spark, sf_dir, "images", "image_signatures", "new_batches"))


_SPLIT = ("images", "image_signatures", "image_subjects", "manual_set_images", "split_plan")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.found(*_t(spark, sf_dir, *_SPLIT))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.report(*_t(spark, sf_dir, *_SPLIT, "batches"))


_LABELS = ("cls_annotations", "annotators", "categories")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(*_t(spark, sf_dir, *_LABELS)).select("annotation_batch_id", "image_id", "category_id")


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement(*_t(spark, sf_dir, "cls_annotations", "annotators"))


def p3_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(*_t(spark, sf_dir, *_LABELS))


_ORIGIN = ("images", "image_subjects", "batches", "source_trust")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.survivors(*_t(spark, sf_dir, *_ORIGIN))


def p4_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.spellings(*_t(spark, sf_dir, *_ORIGIN))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related.groups(*_t(spark, sf_dir, "image_subjects", "image_lineage")).select("image_id", "group_image_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related.splits(*_t(spark, sf_dir, "images", "image_subjects", "image_lineage", "split_plan"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splits have to be, in figures that SQL can state: all images, groups in more than
    one split, and whether each split has its share to a hundredth or the largest group."""
    images, subjects, lineage, plan = _t(spark, sf_dir, "images", "image_subjects", "image_lineage", "split_plan")
    placed = cut(related.splits(images, subjects, lineage, plan), "splits")
    groups = related.groups(subjects, lineage).join(placed, "image_id")
    parted = groups.groupBy("group_image_id").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b"), F.count(F.lit(1)).alias("n"))
    one = F.lit(1).alias("_one")
    facts = parted.agg(F.count_if(F.col("a") != F.col("b")).alias("parted"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).select("*", one)
    total = placed.agg(F.count(F.lit(1)).alias("all_images")).select("*", one)
    known = F.broadcast(facts.join(total, "_one"))  # one row
    own = plan.join(placed.groupBy("split_name").agg(F.count(F.lit(1)).alias("n")), "split_name", "left").select("*", one).join(known, "_one")
    close = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("all_images")) <= F.greatest(F.col("all_images") / 100, F.col("most"))
    return own.select("split_name", "all_images", "parted", close.alias("close"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.map_values(spark, *_t(spark, sf_dir, "categories", "finding_reference"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(*_t(spark, sf_dir, "documents"))


def p8_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(*_t(spark, sf_dir, "documents", "containers"))


def p8_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placement by characters, in figures that SQL can state: pieces and their total, overfull
    containers, and whether the containers are within a hundredth of the volume's bound."""
    documents, kinds = _t(spark, sf_dir, "documents", "containers")
    placed = packing.pack(documents.select("doc_id", "n_chars"), kinds, size_column="n_chars")
    load = placed.groupBy("container_kind", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("load"))
    own = load.join(F.broadcast(kinds.groupBy("container_kind").agg(F.min("capacity_tokens").alias("room"))), "container_kind")  # two rows
    needed = F.count_if(F.col("load") > 0)
    close = needed <= F.ceil(F.sum("load") / F.max("room")) * 1.01 + 1
    return own.groupBy("container_kind").agg(F.sum("pieces").alias("pieces"), F.sum("load").alias("total"), F.count_if(F.col("load") > F.col("room")).alias("overfull"), close.alias("close"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(*_t(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.forms(*_t(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit() and callable(f)}


# Hex values however they are written: lower case, without prefix, separators and white space.
_HEX = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\s\p{{Z}}\p{{Cf}}]+', '', 'g'), '^(blake3[:=]|0x)', ''), '[:_.-]+', '', 'g')"
_IDS = f"""
hashes AS (SELECT id AS image_id, image_batch_id, {_HEX.format("blake3_hash")} AS h FROM images),
digests AS (SELECT image_id, image_batch_id, CASE WHEN regexp_full_match(h, '[0-9a-f]{{64}}') AND h <> repeat(left(h, 1), 64) THEN h END AS digest FROM hashes),
raw_marks AS (SELECT image_id, {_HEX.format("signature")} AS s FROM image_signatures),
marks AS (SELECT DISTINCT image_id, ('0x' || left(s, 16))::UBIGINT AS hi, ('0x' || right(s, 16))::UBIGINT AS lo FROM raw_marks
  WHERE regexp_full_match(s, '[0-9a-f]{{32}}') AND s <> repeat(left(s, 1), 32))"""
_NEAR = "bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= 10"

_NOBODY = "'ANON','ANONYMOUS','ANONYMIZED','ANONYMISED','UNKNOWN','UNK','NONE','NULL','NA','NAN','NIL','MISSING','TBD','X','XX','XXX',''"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_PEOPLE = f"""
spelled AS (SELECT image_id, upper(translate(subject_id, '{_FULL}', '{_HALF}')) AS u FROM image_subjects),
parted AS (SELECT image_id, regexp_replace(u, '[^\\p{{L}}]+', '', 'g') AS letters, regexp_replace(regexp_replace(u, '[^0-9]+', '', 'g'), '^0+', '') AS number FROM spelled WHERE u IS NOT NULL),
people AS (SELECT DISTINCT image_id, letters || '|' || number AS subject FROM parted WHERE NOT (number = '' AND letters IN ({_NOBODY})))"""


# Characters one by one, with tables of their own: fixed values, of letters that look alike and of invisible characters.
_ALIKE = {
    "аеорсухіјѕԁһԝԛӏѵɡοɑνϲϳ": "aeopcyxijsdhwqlvgoavcj", "АВЕЅІЈКМНОРСТУХҮԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABESIJKMHOPCTYXYQWABEZHIKMNOPTYXCJ",
    "ёїѐӓӧӱӯόὸЁЇЀӒӦΪΫΆΈΊΌΎЌӐӑӖӗ": "ëïèäöÿȳóòËÏÈÄÖÏŸÁÉÍÓÝḰĂăĔĕ", "\u2010\u2011\u00b5": "--\u03bc",
}
_UNSEEN = "u IN (173, 847, 1564, 4447, 4448, 6068, 6069, 65279, 917505) OR u BETWEEN 6155 AND 6159 OR u BETWEEN 8203 AND 8207 OR u BETWEEN 8234 AND 8238 OR u BETWEEN 8288 AND 8303 OR u BETWEEN 65024 AND 65039 OR u BETWEEN 65529 AND 65531 OR u BETWEEN 917536 AND 917631 OR u BETWEEN 917760 AND 917999"
_FORMS = f"""spelled AS (SELECT unnest(string_split('{"".join(_ALIKE)}', '')) AS c, unnest(string_split('{"".join(_ALIKE.values())}', '')) AS l),
signs AS (SELECT unnest(['ﬀ', 'ﬁ', 'ﬂ', 'ﬃ', 'ﬄ', 'ﬅ', 'ﬆ', '…']) AS c, unnest(['ff', 'fi', 'fl', 'ffi', 'ffl', 'st', 'st', '...']) AS l),
shown AS (SELECT * FROM spelled UNION ALL SELECT * FROM signs),
cut AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(nfc_normalize(text), '(.)', '\\1' || chr(57344), 'gs'), chr(57344))) AS c, generate_subscripts(string_split_regex(regexp_replace(nfc_normalize(text), '(.)', '\\1' || chr(57344), 'gs'), chr(57344)), 1) AS i FROM documents WHERE text <> ''),
coded AS (SELECT doc_id, i, c, unicode(c) AS u, lag(unicode(c)) OVER w AS before, lead(unicode(c)) OVER w AS after, lag(unicode(c), 2) OVER w AS before2 FROM cut WHERE c <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
letters AS (SELECT doc_id, i, CASE
    WHEN u = 8205 AND (after BETWEEN 8592 AND 11263 OR after BETWEEN 126976 AND 129791) AND (CASE WHEN before = 65039 THEN before2 ELSE before END BETWEEN 8592 AND 11263 OR CASE WHEN before = 65039 THEN before2 ELSE before END BETWEEN 126976 AND 129791) THEN c
    WHEN {_UNSEEN} THEN '' WHEN u IN (160, 5760, 8239, 8287, 12288) OR u BETWEEN 8192 AND 8202 THEN ' '
    WHEN u BETWEEN 65281 AND 65374 THEN chr((u - 65248)::INT) ELSE coalesce(l, c) END AS s FROM coded LEFT JOIN shown USING (c)),
formed AS (SELECT doc_id, nfc_normalize(string_agg(s, '' ORDER BY i)) AS form FROM letters GROUP BY doc_id)"""
_BARE = f"""
bare AS (SELECT id AS image_id, image_batch_id, license_id, CASE WHEN date_captured > DATE '1970-01-01' AND date_captured < DATE '2100-01-01' THEN date_captured END AS day FROM images),
made AS (SELECT batch_id AS image_batch_id, created_at, trust_rank FROM batches LEFT JOIN source_trust USING (original_set_name) WHERE batch_kind = 'image'),
voters AS (SELECT d.digest, b.image_id, b.license_id IS NOT NULL AS license_ok, b.day IS NOT NULL AS date_ok, b.image_id IN (SELECT image_id FROM people) AS subject_ok, m.trust_rank, m.created_at
  FROM bare b JOIN digests d USING (image_id) LEFT JOIN made m ON m.image_batch_id = b.image_batch_id WHERE d.digest IS NOT NULL)"""
_ORDER = "trust_rank ASC NULLS LAST, created_at DESC NULLS LAST, image_id ASC"


def _field(name: str, condition: str, first: str = "") -> str:
    return f"""SELECT group_image_id, '{name}' AS field_name, image_id FROM (
  SELECT v.*, g.group_image_id, row_number() OVER (PARTITION BY digest ORDER BY {first}{_ORDER}) AS place FROM voters v JOIN sizes g USING (digest) WHERE {condition}) WHERE place = 1"""


def _words(value: str) -> str:
    """A value's bare words, in the dialect of the checking engine."""
    full, half = lookalike._quoted(vocabulary.FULLWIDTH), lookalike._quoted(vocabulary.ASCII)
    x = f"lower(translate({value}, {full}, {half}))"
    x = f"translate(regexp_replace({x}, '[\\p{{M}}\\p{{Cf}}]+', '', 'g'), '{vocabulary.MARKED}', '{vocabulary.PLAIN}')"
    x = f"regexp_replace({x}, '^\\s*\\(([^()]*)\\)\\s*$', '\\1')"
    x = f"regexp_replace({x}, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', ' ', 'g')"
    return f"regexp_extract_all({x}, '[a-z]+')"


_MEANT = f"""WITH w AS (SELECT name, {_words("name")} AS w FROM (SELECT DISTINCT name FROM categories WHERE name IS NOT NULL)),
entries AS (SELECT finding_id, array_to_string(e, '') AS form, array_to_string(a, '') AS short, len(e) AS k FROM (SELECT finding_id, {_words("name")} AS e, {_words("abbrev")} AS a FROM finding_reference)),
whole AS (SELECT name, array_to_string(w, '') AS form, len(w) AS n, 0 AS turned FROM w WHERE len(w) > 0 UNION ALL SELECT name, array_to_string(w[2:], '') || w[1], len(w), 1 FROM w WHERE len(w) > 1),
begun AS (SELECT substr(form, 1, n) AS form, min(finding_id) AS finding_id FROM (SELECT finding_id, form, unnest(range({vocabulary.LEAST}, length(form))) AS n FROM entries) GROUP BY 1 HAVING count(DISTINCT finding_id) = 1),
starts AS (SELECT name, w, unnest(range(1, len(w) + 1)) AS i FROM w),
pieces AS (SELECT * FROM whole UNION SELECT name, array_to_string(w[i:i + n - 1], ''), n, 0 FROM (SELECT name, w, i, unnest(range(1, least((SELECT max(k) + 1 FROM entries), len(w) - i + 1) + 1)) AS n FROM starts)),
every AS (
  SELECT name, n, turned AS rank, length(f.form) AS letters, 0 AS slips, 0 AS d, turned, e.finding_id FROM pieces f JOIN entries e ON f.form = e.form
  UNION ALL SELECT name, n, 2, length(f.form), 0, 0, 0, e.finding_id FROM pieces f JOIN entries e ON f.form = e.short WHERE turned = 0 AND e.short <> ''
  UNION ALL SELECT name, n, 3, length(f.form), 0, 0, 0, b.finding_id FROM whole f JOIN begun b ON f.form = b.form WHERE turned = 0
  UNION ALL SELECT name, n, 4, length(f.form), damerau_levenshtein(f.form, e.form), levenshtein(f.form, e.form), turned, e.finding_id FROM pieces f JOIN entries e
    ON abs(length(f.form) - length(e.form)) <= 2 AND damerau_levenshtein(f.form, e.form) <= least(2, least(length(f.form), length(e.form)) // 3)),
meant AS (SELECT name, arg_min(finding_id, (-n, rank, -letters, slips, d, turned, finding_id)) AS finding_id FROM every GROUP BY name)
SELECT c.id AS category_id, coalesce(min(m.finding_id), 0) AS finding_id FROM categories c LEFT JOIN meant m USING (name) WHERE c.id IS NOT NULL GROUP BY c.id"""


_SHARED = f"""{_IDS.lstrip()},{_PEOPLE},
own AS (SELECT DISTINCT m.manual_set_version_id AS version, m.image_id, p.split_name = 'train' AS train FROM manual_set_images m JOIN split_plan p USING (manual_set_version_id)),
rec AS (SELECT o.*, d.digest, q.subject, m.hi, m.lo FROM own o LEFT JOIN digests d USING (image_id) LEFT JOIN people q USING (image_id) LEFT JOIN marks m USING (image_id)),
e AS (SELECT * FROM rec WHERE NOT train), t AS (SELECT * FROM rec WHERE train),
pairs AS (
  SELECT x.version, x.image_id AS a, y.image_id AS b, 'content' AS reason FROM e x JOIN t y ON x.digest = y.digest
  UNION ALL SELECT x.version, x.image_id, y.image_id, 'subject' FROM e x JOIN t y ON x.subject = y.subject
  UNION ALL SELECT x.version, x.image_id, y.image_id, 'member' FROM e x JOIN t y ON x.image_id = y.image_id
  UNION ALL SELECT x.version, x.image_id, y.image_id, 'near' FROM e x JOIN t y ON {_NEAR})"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _MEANT,
        "p3_agreement": f"""WITH who AS (SELECT id, regexp_replace(translate(lower(translate(name, '{_FULL}', '{_HALF}')), 'аеорсухіѕԁһԝԛјӏɡкνο', 'aeopcyxisdhwqjlgkvo'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM annotators),
people AS (SELECT id, CASE WHEN k IS NULL OR k = '' THEN id ELSE min(id) OVER (PARTITION BY k) END AS person FROM who),
claims AS (SELECT DISTINCT annotation_batch_id AS b, image_id AS i, category_id AS c, coalesce(person, annotator_id) AS p FROM cls_annotations l LEFT JOIN people ON people.id = l.annotator_id
  WHERE score > 0 AND annotation_batch_id IS NOT NULL AND image_id IS NOT NULL AND category_id IS NOT NULL AND annotator_id IS NOT NULL),
counted AS (SELECT b, i, c, count(*) AS n FROM claims GROUP BY ALL),
item AS (SELECT b, i, sum(n) AS m, sum(n * n) AS q FROM counted GROUP BY ALL HAVING sum(n) >= 2),
seen AS (SELECT b, count(*) AS items, sum(m) AS r, sum((m * m - q)::DOUBLE / (m - 1)) AS pairs FROM item GROUP BY b),
share AS (SELECT b, sum(t * t) AS squares FROM (SELECT b, c, sum(n) AS t FROM counted JOIN item USING (b, i) GROUP BY b, c) GROUP BY b),
rates AS (SELECT b, items, r, pairs / r AS seen_, (r * r - squares)::DOUBLE / (r * (r - 1)) AS chance FROM seen JOIN share USING (b))
SELECT b AS annotation_batch_id, items::BIGINT AS items, r::BIGINT AS ratings, seen_ AS observed_disagreement, chance AS expected_disagreement, CASE WHEN chance > 0 THEN 1 - seen_ / chance END AS alpha FROM rates""",
        "p4_found": f"""WITH {_IDS.lstrip()},{_PEOPLE},{_BARE},
sizes AS (SELECT digest, min(image_id) AS group_image_id FROM voters GROUP BY digest HAVING count(*) > 1)
{_field("license_id", "license_ok")} UNION ALL {_field("date_captured", "date_ok")} UNION ALL {_field("subject_id", "subject_ok")}
UNION ALL {_field("record", "true", "license_ok::INT + date_ok::INT + subject_ok::INT DESC, ")}""",
        "p5_found": f"""WITH RECURSIVE {_PEOPLE.lstrip()},
rep AS (SELECT image_id, min(image_id) OVER (PARTITION BY subject) AS head FROM people),
edges AS (SELECT image_id AS a, head AS b FROM rep WHERE image_id <> head UNION SELECT parent_image_id, child_image_id FROM image_lineage WHERE parent_image_id <> child_image_id),
either_way AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS root FROM either_way UNION SELECT e.b, r.root FROM reach r JOIN either_way e ON e.a = r.node WHERE r.root < e.b)
SELECT node AS image_id, min(root) AS group_image_id FROM reach GROUP BY node""",
        "p5_shares": "SELECT split_name, (SELECT count(DISTINCT id) FROM images) AS all_images, 0::BIGINT AS parted, true AS close FROM split_plan",
        "p8_by_length": """SELECT container_kind, sum(greatest(1, ceil(coalesce(n_chars, 0) / capacity_tokens)))::BIGINT AS pieces, sum(coalesce(n_chars, 0))::BIGINT AS total, 0::BIGINT AS overfull, true AS close
FROM documents, containers GROUP BY container_kind""",
        "p9_found": f"""WITH {_FORMS},
shown_ AS (SELECT doc_id, text, form FROM formed JOIN documents USING (doc_id) WHERE regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]'))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM shown_ a JOIN shown_ b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
        "p9_forms": f"WITH {_FORMS} SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(form, '') END AS form FROM documents LEFT JOIN formed USING (doc_id)",
        "p1_found": f"""WITH {_IDS.lstrip()},
rec AS (SELECT d.*, m.hi, m.lo, n.image_batch_id IS NOT NULL AS fresh FROM digests d LEFT JOIN marks m USING (image_id) LEFT JOIN new_batches n USING (image_batch_id)),
fresh AS (SELECT * FROM rec WHERE fresh),
pairs AS (
  SELECT x.image_id AS a, y.image_id AS b FROM fresh x JOIN rec y ON x.digest = y.digest WHERE x.image_batch_id <> y.image_batch_id
  UNION ALL
  SELECT x.image_id, y.image_id FROM fresh x JOIN rec y ON {_NEAR} WHERE x.image_batch_id <> y.image_batch_id)
SELECT DISTINCT least(a, b) AS image_id_a, greatest(a, b) AS image_id_b FROM pairs""",
        "p2_found": f"""WITH {_SHARED}
SELECT DISTINCT version AS eval_version_id, least(a, b) AS image_id_a, greatest(a, b) AS image_id_b FROM pairs""",
        "p2_report": f"""WITH {_SHARED},
sets AS (SELECT i.id AS a, original_set_name FROM images i LEFT JOIN batches b ON b.batch_kind = 'image' AND b.batch_id = i.image_batch_id)
SELECT version AS eval_version_id, original_set_name, reason, count(DISTINCT a) AS eval_images, count(*) AS pairs
FROM (SELECT DISTINCT * FROM pairs) LEFT JOIN sets USING (a) GROUP BY ALL""",
    }

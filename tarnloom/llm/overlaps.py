"""Same or near-same records across splits.

A record is turned into positional words: its content digest (eight words of
four bytes), its subject (letters, number), its own id, and the segments of its
picture signature. Grams of five words (all words where there are fewer) are
hashed. The distinct evaluation values' gram hashes are partitioned, the
distinct training values' grams are scanned for hits, and hits / grams is the
containment of an evaluation record in a training record. Digests, subjects and
ids have to be contained whole, and are then compared as they are.

Ten scattered bits can leave no run of words whole, so for signatures single
bits are the words: containment is the share of 128 bits, 118 / 128 is near-same,
and the pairs are found by segments probed together with their near values (see
``nearbits``), so that none within the radius is missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import kept, with_hex, with_subject
from ..functions.spread import cut, lookup, salted_join, small
from . import nearbits

RADIUS = 10
BLOCK = 50_000
GRAM = 5  # words
WORD = 8  # hex digits of a digest's word


def members(images: DataFrame, signatures: DataFrame, subjects: DataFrame, memberships: DataFrame, plan: DataFrame) -> DataFrame:
    """(image_id, version, train, digest, subject, hi, lo) of each membership.

    The train split is the plan's row named train (case aside); all other
    planned versions are evaluation splits. Memberships of unplanned versions,
    null ids and repeated rows are dropped.
    """
    role = plan.where("manual_set_version_id is not null").groupBy("manual_set_version_id").agg(F.max(F.lower(F.trim("split_name")) == "train").alias("train"))
    own = memberships.where("image_id is not null").select("manual_set_version_id", "image_id").distinct().join(small(role), "manual_set_version_id")
    marks = kept(nearbits.with_signature(signatures.select("image_id", "signature")), "hi", "lo").drop("signature").distinct()
    people = kept(with_subject(subjects.select("image_id", "subject_id"), "subject_id", "subject"), "subject").drop("subject_id").distinct()
    base = with_hex(images.select(F.col("id").alias("image_id"), "blake3_hash"), "blake3_hash", 64, "digest").drop("blake3_hash")
    joined = own.join(base, "image_id", "left").join(people, "image_id", "left").join(marks, "image_id", "left")
    return joined.select("image_id", F.col("manual_set_version_id").alias("version"), F.coalesce("train", F.lit(False)).alias("train"), "digest", "subject", "hi", "lo")


def grams(values: DataFrame) -> DataFrame:
    """``values`` (reason, value, ...) with ``gram``, a row for each hashed gram, ``at``, its place,
    and ``grams``, their number."""
    starts = range(0, 64 - GRAM * WORD + 1, WORD)
    digest = F.array(*[F.struct(F.lit(k).alias("at"), F.xxhash64("reason", F.lit(k), F.substring("value", i + 1, GRAM * WORD)).alias("gram")) for k, i in enumerate(starts)])
    short = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("reason", F.lit(0), "value").alias("gram")))
    full = F.when(F.col("reason") == "content", digest).otherwise(short)
    return values.withColumn("_g", full).withColumn("grams", F.size("_g")).withColumn("_g", F.explode("_g")).select("*", "_g.at", "_g.gram").drop("_g")


def contained(evaluation: DataFrame, train: DataFrame) -> DataFrame:
    """(reason, value, containment, n, m): values (reason, value) of evaluation records that a
    training record contains whole; n training and m evaluation rows have them."""

    def side(rows: DataFrame, mark: str) -> DataFrame:
        own = rows.groupBy("reason", "value").agg(F.count(F.lit(1)).alias("rows"))
        first = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(f"{c}_{mark}")
        return grams(own).select("gram", F.xxhash64("reason", "value").alias(mark), F.col("grams").alias(f"grams_{mark}"), first("reason"), first("value"), first("rows"))

    hits = side(evaluation, "e").join(side(train, "t"), "gram").groupBy("e", "t", "grams_e")
    facts = [F.max(c).alias(c) for c in ("reason_e", "value_e", "value_t", "rows_e", "rows_t")]
    found = hits.agg(F.count(F.lit(1)).alias("hits"), *facts).withColumn("containment", F.col("hits") / F.col("grams_e"))
    exact = found.where((F.col("containment") >= 1) & (F.col("value_e") == F.col("value_t")))
    return exact.select(F.col("reason_e").alias("reason"), F.col("value_e").alias("value"), "containment", F.col("rows_t").alias("n"), F.col("rows_e").alias("m"))


def overlaps(images: DataFrame, signatures: DataFrame, subjects: DataFrame, memberships: DataFrame, plan: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(eval_version_id, eval_image_id, train_image_id, reason, containment).

    reason is member (the image is in both splits), content, near or subject; a
    pair has a row for each reason. Missing values and placeholders match
    nothing; empty inputs give no rows.
    """
    own = cut(members(images, signatures, subjects, memberships, plan), "members")
    value = lambda reason, column: F.struct(F.lit(reason).alias("reason"), column.alias("value"))
    every = F.array(value("member", F.col("image_id").cast("string")), value("content", F.col("digest")), value("subject", F.col("subject")))
    values = own.select("version", "train", "image_id", F.explode(every).alias("v")).where("v.value is not null").select("version", "train", "image_id", "v.reason", "v.value")
    # an image with several signatures or subjects has several rows
    e = values.where("not train").select(F.col("version").alias("eval_version_id"), F.col("image_id").alias("eval_image_id"), "reason", "value").distinct()
    t = values.where("train").select(F.col("image_id").alias("train_image_id"), "reason", "value").distinct()
    matched = cut(contained(e, t), "matched")
    key = ["reason", "value"]
    left, right = lookup(matched.select(*key, "containment"), e, key, block), lookup(matched.select(*key), t, key, block)
    whole = salted_join(left, right, key, matched, block).select("eval_version_id", "eval_image_id", "train_image_id", "reason", "containment")
    # single bits as words, on distinct signatures
    ev = own.where("not train and hi is not null").select("hi", "lo", F.col("version").alias("eval_version_id"), F.col("image_id").alias("eval_image_id")).distinct()
    tr = own.where("train and hi is not null").select("hi", "lo", F.col("image_id").alias("train_image_id")).distinct()
    marks = [cut(side.select("hi", "lo").distinct(), "marks") for side in (ev, tr)]
    near = cut(nearbits.near(*marks, radius), "near")
    ends = [near.select(F.col(f"{k}_hi").alias("hi"), F.col(f"{k}_lo").alias("lo")).distinct() for k in ("p", "i")]
    close = nearbits.expand(near, *[lookup(end, side, ["hi", "lo"], block) for side, end in zip((ev, tr), ends)], block)
    close = close.select("eval_version_id", "eval_image_id", "train_image_id", F.lit("near").alias("reason"), (F.col("shared") / nearbits.BITS).alias("containment"))
    key = ["eval_version_id", "eval_image_id", "train_image_id", "reason"]
    return whole.union(close).groupBy(*key).agg(F.max("containment").alias("containment"))


def found(*tables: DataFrame) -> DataFrame:
    """(eval_version_id, image_id_a, image_id_b), a <= b, each case once."""
    a, b = F.col("eval_image_id"), F.col("train_image_id")
    # an image paired with itself is a case only as a member of both splits
    pairs = overlaps(*tables)
    return pairs.select("eval_version_id", F.least(a, b).alias("image_id_a"), F.greatest(a, b).alias("image_id_b")).distinct()


def report(images: DataFrame, signatures: DataFrame, subjects: DataFrame, memberships: DataFrame, plan: DataFrame, batches: DataFrame) -> DataFrame:
    """(eval_version_id, original_set_name, reason, eval_images, pairs): overlaps by split and source of the evaluation image."""
    sets = batches.where("batch_kind = 'image'").select(F.col("batch_id").alias("image_batch_id"), "original_set_name").dropDuplicates(["image_batch_id"])
    source = images.select(F.col("id").alias("eval_image_id"), "image_batch_id").join(small(sets), "image_batch_id", "left").drop("image_batch_id")
    pairs = overlaps(images, signatures, subjects, memberships, plan).join(source, "eval_image_id", "left")
    return pairs.groupBy("eval_version_id", "original_set_name", "reason").agg(F.countDistinct("eval_image_id").alias("eval_images"), F.count(F.lit(1)).alias("pairs"))
